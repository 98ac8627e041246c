"""The seven transport-affordability reports.

Each function takes microdata tables and returns a ``Report``: one row per income decile
with a column per measure, the workbook sheets made of them, and national figures.
The household base is staged once; all measures of all deciles come from one grouped
pass over it.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.deciles import FIXED_CUTS, NATIONAL, PROBS, assign_decile, decile_dim, decile_label
from ..functions.items import HOUSEHOLD_KEYS, with_annual_amounts
from ..functions.products import CODES, items_in
from ..functions.thresholds import attach_threshold, gap, is_below
from ..operators.design import Design
from ..operators.estimate import point_estimates, svy_estimates
from ..operators.frequency import calibrated_cells, crosstab, freq, mean_by, svy_table
from ..operators.first_row import RowOrder
from ..operators.household import FIRST_ROW_ORDER, household_base, na_sum, with_post_strata
from ..operators.quantile import quantile_values, svy_quantile
from ..workspace import Workspace

QUIRKS = ("reference", "fixed")


@dataclass(frozen=True)
class Survey:
    """The tables of one survey and how to read them."""

    items: DataFrame | None = None
    conditions: DataFrame | None = None
    post_strata: DataFrame | None = None
    keys: Sequence[str] = HOUSEHOLD_KEYS
    order: RowOrder | Sequence[str] = FIRST_ROW_ORDER
    post_strata_on: Sequence[str] | None = None
    null_safe: bool = True
    codes: dict[str, Collection[int]] = field(default_factory=lambda: dict(CODES))


@dataclass(frozen=True)
class Report:
    table: DataFrame
    sheets: dict[str, str]
    national: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def sheet_tables(self) -> dict[str, DataFrame]:
        """``(decil, label, value)`` per sheet, in report order."""
        return {
            name: self.table.select("decil", _label(), F.col(measure).alias("value"))
            for name, measure in self.sheets.items()
        }

    def all_sheets(self) -> DataFrame:
        """``(decil, label, sheet, value)``: every sheet from one evaluation of the table."""
        return self._unpivoted("sheet", self.sheets)

    def stacked(self, measures: Sequence[str]) -> DataFrame:
        """``(decil, label, measure, value)``: the measures below one another."""
        return self._unpivoted("measure", {m: m for m in measures})

    def _unpivoted(self, key: str, columns: dict[str, str]) -> DataFrame:
        pairs = [
            F.struct(F.lit(name).alias(key), F.col(column).alias("value"))
            for name, column in columns.items()
        ]
        return self.table.select("decil", _label(), F.inline(F.array(*pairs)))


def _label():
    return decile_label(F.col("decil")).alias("label")


def base_design(survey: Survey, codes: str, plus_one: bool) -> Design:
    """Households with spending on ``codes`` and their post-strata, as a design."""
    items = with_annual_amounts(items_in(survey.items, survey.codes[codes]))
    base = household_base(items, keys=survey.keys, order=survey.order, quirk_plus_one=plus_one,
                          keep=("estrato_pof", "uf", "cod_upa", "renda_anual", "peso", "peso_final"))
    joined = with_post_strata(base, survey.post_strata, survey.post_strata_on, survey.null_safe)
    return Design(joined)


def staged_design(survey: Survey, codes: str, plus_one: bool, space: Workspace) -> Design:
    """The base written once to the shared folder, and checked for missing design values."""
    return base_design(survey, codes, plus_one).staged(space, f"households_{codes}")


def income_cuts(design: Design) -> list[float | None]:
    """The nine upper limits of the income deciles."""
    cuts = quantile_values(svy_quantile(design, "renda_anual", PROBS))[:9]
    return cuts or [None] * 9


def cuts_and_median(design: Design) -> tuple[list[float | None], float | None]:
    """Income cuts and the median spend of all families, in the same passes."""
    wanted = [("renda_anual", p) for p in PROBS] + [("gasto_total", 0.5)]
    probs = design.df.sparkSession.createDataFrame(wanted, "variable string, p double")
    found = svy_quantile(design, ["renda_anual", "gasto_total"], probs)
    rows = sorted(found.collect(), key=lambda r: r["p"])
    cuts = [r["quantile"] for r in rows if r["variable"] == "renda_anual"][:9]
    medians = [r["quantile"] for r in rows if r["variable"] == "gasto_total"]
    return cuts or [None] * 9, medians[0] if medians else None


def by_decile(table: DataFrame, national: bool = False, zero: Sequence[str] = ()) -> DataFrame:
    """Ten (or eleven) ordered rows whatever deciles the sample has.

    ``zero`` columns are 0 in deciles without rows; what is unknown stays NULL.

    ``table`` is grouped by decile, so it has twelve rows at most and is broadcast; the
    dimension is one partition, so its order is the report's order.
    """
    rows = decile_dim(table.sparkSession, national).select("decil")
    full = rows.join(F.broadcast(table.withColumn("_there", F.lit(True))), "decil", "left")
    filled = {c: F.when(F.col("_there").isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in zero}
    return full.withColumns(filled).drop("_there").sortWithinPartitions("decil")


def national_table(estimates: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide row of estimates and errors as ``(measure, estimate, se)``."""
    rows = [
        F.struct(
            F.lit(n).alias("measure"),
            F.col(n).alias("estimate"),
            F.col(f"{n}_se").alias("se"),
        )
        for n in names
    ]
    return estimates.select(F.inline(F.array(*rows)))


# Perception of public transport -------------------------------------------------------

ANSWERS = {"bom": 1, "satisfatorio": 2, "ruim": 3, "nao_tem": 4}


def perception(survey: Survey) -> Report:
    """Weighted families per decile: all, and by answer on public transport.

    Monthly income is placed by the fixed published cuts.  The overall column uses the
    plain weight and the answers post-stratified ones, so they need not add up.
    """
    rows = with_post_strata(
        survey.conditions, survey.post_strata, survey.post_strata_on, survey.null_safe
    )
    rows = assign_decile(rows, "renda_total", FIXED_CUTS)
    design = Design(rows)
    cells = calibrated_cells(design, "decil", "v61058").dropna(subset=["decil"])
    answers = [
        F.coalesce(F.sum(F.when(F.col("v61058") == code, F.col("calibrated"))), F.lit(0.0)).alias(name)
        for name, code in ANSWERS.items()
    ]
    table = cells.groupBy("decil").agg(F.sum("freq").alias("familias"), *answers)
    table = by_decile(table, zero=["familias", *ANSWERS])
    sheets = {f"Resultado_{i}": c for i, c in enumerate(["familias", *ANSWERS], 1)}
    extra = {
        "avaliacao": freq(survey.conditions, "v61058"),
        "avaliacao_ponderada": svy_table(design, "v61058"),
        "avaliacao_por_decil": crosstab(rows, "v61058", "decil", range(1, 11)),
    }
    return Report(table, sheets, extra=extra)


# Spend by income decile ---------------------------------------------------------------


def spend_by_decile(survey: Survey, space: Workspace, codes: str = "fuel") -> Report:
    """Mean annual income and mean spend on ``codes`` by income decile."""
    design = staged_design(survey, codes, False, space)
    rows = assign_decile(design.df, "renda_anual", income_cuts(design))
    measures = {
        "media_renda": ("mean", "renda_anual"),
        "media_gasto": ("mean", "gasto_total"),
    }
    sheets = {"Resultado_1": "media_renda", "Resultado_2": "media_gasto"}
    if codes != "fuel":
        sheets = {"Resultado_3": "media_gasto"}
    extra = {"sem_desenho": mean_by(rows, "decil", ["renda_anual", "gasto_total"])}
    return Report(
        by_decile(point_estimates(design.on(rows), measures, ["decil"])), sheets, extra=extra
    )


# Distance to a median -----------------------------------------------------------------


@dataclass(frozen=True)
class TransportBase:
    """Staged households with transport spending, their decile, and the median spend."""

    design: Design
    median: float | None
    quirks: str

    def counted(self, columns: Sequence[str]) -> Sequence[str]:
        """Columns that are 0 where no family is below: none if the median is unknown."""
        return columns if self.median is not None else ()

    def below_half(self) -> Design:
        """Families below half the median spend, with their shortfall ``valor_total``."""
        rows = attach_threshold(self.design.df, self.median)
        rows = rows.filter(is_below("gasto_total", 0.5))
        return self.design.on(rows.withColumn("valor_total", gap("gasto_total", 0.5)))

    def below_median(self) -> Design:
        rows = attach_threshold(self.design.df, self.median).filter(is_below("gasto_total"))
        return self.design.on(rows.withColumn("valor_total", gap("gasto_total")))

    @cached_property
    def decile_medians(self) -> DataFrame:
        """``(decil, p, threshold)``, computed once for the reports that share this base."""
        rows = self.design.df.filter(F.col("decil").isNotNull())
        medians = svy_quantile(self.design.on(rows), "gasto_total", [0.5], ["decil"])
        return medians.withColumnRenamed("quantile", "threshold")

    def with_decile_median(self) -> Design:
        """Families with a decile and its median spend as ``threshold``."""
        rows = self.design.df.filter(F.col("decil").isNotNull())
        return self.design.on(attach_threshold(rows, self.decile_medians, "decil"))


def transport_base(survey: Survey, space: Workspace, quirks: str = "reference") -> TransportBase:
    """The common start of the four median reports; build it once and pass it to each.

    ``reference`` keeps two published peculiarities: every household total is 1 too high,
    and the decile-median report looks above the median in decile 10.
    """
    if quirks not in QUIRKS:
        raise ValueError(f"quirks must be one of {QUIRKS}")
    design = staged_design(survey, "all", quirks == "reference", space)
    cuts, median = cuts_and_median(design)
    return TransportBase(
        design.on(assign_decile(design.df, "renda_anual", cuts)), median, quirks
    )


def families_below_decile_median(base: TransportBase) -> Report:
    """Families, median spend, families below it and their mean spend, per decile."""
    design = base.with_decile_median()
    side = is_below("gasto_total", top_decile_above=base.quirks == "reference")
    measures = {
        "familias": ("total", 1.0),
        "familias_abaixo": ("total", 1.0, side),
        "gasto_medio_abaixo": ("mean", "gasto_total", side),
    }
    table = point_estimates(design, measures, ["decil", "threshold"])
    table = table.withColumnRenamed("threshold", "mediana")
    sheets = {
        "Resultado_1": "familias",
        "Resultado_2": "mediana",
        "Resultado_3": "familias_abaixo",
        "Resultado_4": "gasto_medio_abaixo",
    }
    everyone = svy_estimates(base.design, {"familias": ("total", 1.0)})
    below = svy_estimates(
        base.below_median(),
        {"familias_abaixo": ("total", 1.0), "gasto_medio_abaixo": ("mean", "gasto_total")},
    )
    national = national_table(everyone, ["familias"]).unionByName(
        national_table(below, ["familias_abaixo", "gasto_medio_abaixo"])
    )
    return Report(
        by_decile(table, zero=["familias", "familias_abaixo"]).select("decil", *sheets.values()),
        sheets,
        national,
    )


def gap_to_decile_median(base: TransportBase) -> Report:
    """Mean shortfall to the own decile's median; nationally, mean and total to the median."""
    design = base.with_decile_median()
    below = design.df.filter(is_below("gasto_total")).withColumn("valor_total", gap("gasto_total"))
    table = point_estimates(design.on(below), {"media_dif": ("mean", "valor_total")}, ["decil"])
    national = svy_estimates(
        base.below_median(),
        {"media_dif": ("mean", "valor_total"), "total_dif": ("total", "valor_total")},
    )
    return Report(
        by_decile(table),
        {"Resultado_1": "media_dif"},
        national_table(national, ["media_dif", "total_dif"]),
    )


def half_median_detail(base: TransportBase) -> Report:
    """Families below half the median spend: number, spend and shortfall, per decile."""
    poor = base.below_half()
    means = {
        "familias": ("total", 1.0),
        "gasto_medio": ("mean", "gasto_total"),
        "dif_media": ("mean", "valor_total"),
    }
    table = point_estimates(poor, means, ["decil"])
    # The national cells are the deciles' cells added up.
    medians = (
        svy_quantile(poor, ["gasto_total", "valor_total"], [0.5], ["decil"], whole=NATIONAL)
        .groupBy("decil")
        .agg(
            F.max(F.when(F.col("variable") == "gasto_total", F.col("quantile"))).alias("gasto_mediano"),
            F.max(F.when(F.col("variable") == "valor_total", F.col("quantile"))).alias("dif_mediana"),
        )
    )
    sheets = {
        "Resultado_1": "familias",
        "Resultado_2": "gasto_medio",
        "Resultado_3": "gasto_mediano",
        "Resultado_4": "dif_media",
        "Resultado_5": "dif_mediana",
    }
    national = national_table(svy_estimates(poor, means), list(means))
    return Report(
        by_decile(table.join(F.broadcast(medians), "decil"), zero=base.counted(["familias"])).select(
            "decil", *sheets.values()
        ),
        sheets,
        national,
        {"medianas": medians.filter(F.col("decil") == NATIONAL).drop("decil")},
    )


def half_median_totals(base: TransportBase) -> Report:
    """Total shortfall to half the median spend, per decile and as an eleventh row."""
    sums = point_estimates(base.below_half(), {"extrapolacao": ("total", "valor_total")}, ["decil"])
    # The national row adds the twelve sums; families without a decile count there only.
    codes = F.explode(F.array("decil", F.lit(NATIONAL))).alias("decil")
    table = sums.select(codes, "extrapolacao").dropna(subset=["decil"])
    table = table.groupBy("decil").agg(na_sum("extrapolacao").alias("extrapolacao"))
    zero = base.counted(["extrapolacao"])
    return Report(by_decile(table, national=True, zero=zero), {"Resultado_1": "extrapolacao"})
