"""Weighted totals and means, with stratified-cluster standard errors.

Standard errors use with-replacement linearisation.  Rows are read once and merged to PSU
sums of w*y and w.  Everything after works on that table: group totals are joined back to
the PSUs to give linearised values, whose spread is taken per stratum by a stable
variance and added up per group.  Both uses of the PSU sums read all their columns, so
Spark computes and shuffles them once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import same
from .design import Design

Measure = tuple  # (stat, column[, condition])


def svy_total(design: Design, y, by: Sequence[str] = (), **options) -> DataFrame:
    """``(by, estimate, se)`` of the weighted total of ``y`` (a name, number or Column)."""
    return _one(design, "total", y, by, options)


def svy_mean(design: Design, y, by: Sequence[str] = (), **options) -> DataFrame:
    """``(by, estimate, se)`` of the weighted mean of ``y``."""
    return _one(design, "mean", y, by, options)


def svy_by(design: Design, y, by: Sequence[str], stat: str = "mean", **options) -> DataFrame:
    """A statistic for every level of ``by``, in one pass."""
    return _one(design, stat, y, by, options)


def _one(design, stat, y, by, options) -> DataFrame:
    return svy_estimates(design, {"estimate": (stat, y)}, by, **options).withColumnRenamed(
        "estimate_se", "se"
    )


def point_estimates(
    design: Design,
    measures: dict[str, Measure],
    by: Sequence[str] = (),
    na_rm: bool = False,
    rollup: bool = False,
) -> DataFrame:
    """Estimates without errors, all in one pass; a measure may hold for a subset only.

    A measure is ``(stat, column)`` or ``(stat, column, condition)``.  A subset without
    rows has total 0 and mean NULL; where a condition is unknown for a row, so is the
    estimate, unless ``na_rm``.  ``rollup`` adds sub-totals and ``level``, the number
    of ``by`` columns a row sums over as a bit mask.
    """
    w = F.col(design.weight)
    out = []
    for name, (stat, y, *condition) in measures.items():
        y = _column(y)
        inside = condition[0] if condition else F.lit(True)
        weighted = F.sum(F.when(inside, w * y))
        if stat == "mean":
            value = weighted / F.nullif(F.sum(F.when(inside & y.isNotNull(), w)), F.lit(0.0))
        else:
            value = F.coalesce(weighted, F.lit(0.0))
        if not na_rm:
            value = F.when(F.count_if(inside.isNull() | (inside & y.isNull())) == 0, value)
        out.append(value.alias(name))
    if rollup:
        return design.df.rollup(*by).agg(F.grouping_id().alias("level"), *out)
    return design.df.groupBy(*by).agg(*out)


def svy_estimates(
    design: Design,
    measures: dict[str, Measure],
    by: Sequence[str] = (),
    where: Column | None = None,
    na_rm: bool = False,
    domain: bool = False,
    with_df: bool = False,
) -> DataFrame:
    """``(by, name, name_se, ...)`` for measures ``{name: (stat, column)}``.

    ``where`` restricts the rows.  By default the design is declared on the restricted
    rows of each group, so only their PSUs count; ``domain`` keeps the PSUs of the whole
    table, with zeros.  ``with_df`` adds PSUs minus strata.
    """
    by = list(by)
    rows = design.df if where is None else design.df.filter(where)
    stats = [stat for stat, _ in measures.values()]
    psus = _psu_sums(rows, design, measures, by, na_rm)
    values = _linearised(psus, by, stats, design.lonely_psu, na_rm)
    strata = values.groupBy(*by, F.col(design.strata).alias("_h")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[c for i in range(len(stats)) for c in _stratum_spread(i)],
    )
    absent = F.lit(0)
    if domain:
        strata, all_psus, lonely = _with_all_psus(strata, design)
        absent = lonely - F.count_if(F.col("_nf") == 1)
    else:
        strata, all_psus = strata.withColumn("_nf", F.col("_n")), F.sum("_n")
    columns = []
    for i, name in enumerate(measures):
        estimate = F.max(f"_est{i}")
        columns.append(estimate.alias(name))
        columns.append(F.when(estimate.isNotNull(), F.sqrt(_variance(i, absent))).alias(f"{name}_se"))
    if with_df:
        columns.append((all_psus - F.count(F.lit(1))).alias("df"))
    if domain and design.lonely_psu == "adjust":
        strata = _recentred(strata, all_psus, stats)
    return strata.groupBy(*by).agg(*columns)


def _column(y) -> Column:
    if isinstance(y, Column):
        return y
    if isinstance(y, str):
        return F.col(y).cast("double")
    return F.lit(float(y))


def _psu_sums(rows: DataFrame, design: Design, measures, by, na_rm: bool) -> DataFrame:
    w = F.col(design.weight)
    sums = []
    for i, (_, y) in enumerate(measures.values()):
        y = _column(y)
        sums += [
            F.sum(F.when(y.isNull(), 0.0).otherwise(w * y)).alias(f"_y{i}"),
            F.sum(F.when(y.isNull(), 0.0).otherwise(w)).alias(f"_w{i}"),
        ]
        if not na_rm:
            sums.append(F.count_if(y.isNull()).alias(f"_na{i}"))
    return rows.groupBy(*by, design.strata, design.psu).agg(*sums)


def _linearised(psus: DataFrame, by, stats, lonely_psu: str, na_rm: bool) -> DataFrame:
    """PSU rows with the group's estimate, its linearised value and the lonely-PSU centre."""
    sums = [F.count(F.lit(1)).alias("_m")]
    for i in range(len(stats)):
        parts = ("y", "w") if na_rm else ("y", "w", "na")
        sums += [F.sum(f"_{part}{i}").alias(f"_t{part}{i}") for part in parts]
    totals = psus.groupBy(*by).agg(*sums)
    if by:
        other = [f"_g_{k}" for k in by]
        totals = totals.withColumnsRenamed(dict(zip(by, other)))
        joined = psus.join(totals, same(psus, totals, by, other)).drop(*other)
    else:
        whole = totals.select(F.struct(*totals.columns)).scalar()
        joined = psus.withColumn("_whole", whole).select("*", "_whole.*").drop("_whole")
    columns = []
    for i, stat in enumerate(stats):
        y, w = F.col(f"_y{i}"), F.col(f"_w{i}")
        if stat == "total":
            estimate, z = F.col(f"_ty{i}"), y
            centre = estimate / F.col("_m") if lonely_psu == "adjust" else F.lit(0.0)
        elif stat == "mean":
            # Linearised values of a mean sum to zero, so both centrings agree.
            whole_w = F.nullif(F.col(f"_tw{i}"), F.lit(0.0))
            estimate, centre = F.col(f"_ty{i}") / whole_w, F.lit(0.0)
            z = (y - estimate * w) / whole_w
        else:
            raise ValueError(f"unknown statistic {stat!r}")
        if not na_rm:
            z = F.when(F.col(f"_na{i}") == 0, z)
            estimate = F.when(F.col(f"_tna{i}") == 0, estimate)
        columns += [z.alias(f"_z{i}"), estimate.alias(f"_est{i}"), centre.alias(f"_c{i}")]
    keys = [c for c in psus.columns if not c.startswith("_")]
    return joined.select(*keys, *columns)


def _stratum_spread(i: int) -> list[Column]:
    z = f"_z{i}"
    return [
        F.sum(z).alias(f"_sz{i}"),
        F.coalesce(F.var_samp(z), F.lit(0.0)).alias(f"_v{i}"),
        *[F.max(f"_{name}{i}").alias(f"_{name}{i}") for name in ("est", "c")],
    ]


def _with_all_psus(strata: DataFrame, design: Design) -> tuple[DataFrame, Column, Column]:
    """Strata with their PSUs in the whole table; all its PSUs, and its strata of one PSU."""
    every = (
        design.df.groupBy(design.strata, design.psu)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(F.col(design.strata).alias("_hf"))
        .agg(F.count(F.lit(1)).alias("_nf"))
    )
    joined = strata.join(every, same(strata, every, ["_h"], ["_hf"]))
    whole = every.agg(F.sum("_nf").alias("psus"), F.count_if(F.col("_nf") == 1).alias("lonely"))
    return joined, F.lit(whole.select("psus").scalar()), F.lit(whole.select("lonely").scalar())


def _recentred(strata: DataFrame, all_psus: Column, stats) -> DataFrame:
    # With the PSUs of the whole table the mean of all PSU sums is another one.
    totals = [i for i, stat in enumerate(stats) if stat == "total"]
    whole = strata.withColumn("_all", all_psus)
    return whole.withColumns({f"_c{i}": F.col(f"_est{i}") / F.col("_all") for i in totals})


def _variance(i: int, absent: Column) -> Column:
    """Sum over strata; PSUs of the design without rows count as zeros.

    ``absent`` strata of one PSU have no row in the group: each deviates by the centre.
    """
    n, full, z = F.col("_n"), F.col("_nf"), F.col(f"_sz{i}")
    squares = (n - 1) * F.col(f"_v{i}") + z * z / n * (1.0 - n / full)
    alone = z - F.col(f"_c{i}")
    spread = full / F.nullif(full - 1, F.lit(0))
    present = F.sum(F.when(full > 1, spread * squares).otherwise(alone * alone))
    return present + absent * F.pow(F.max(f"_c{i}"), F.lit(2.0))
