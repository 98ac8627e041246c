"""One registered query per operator, over the survey seen in the order tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthstat.functions import deciles, items as item_exprs, products, thresholds
from hearthstat.functions.deciles import NATIONAL, PROBS
from hearthstat.operators import frequency, household
from hearthstat.operators.design import Design, population_totals, post_stratify
from hearthstat.operators.estimate import point_estimates, svy_by, svy_estimates, svy_mean, svy_total
from hearthstat.operators.interval import svy_quantile_ci
from hearthstat.operators.quantile import svy_quantile
from hearthstat.plans import indicators as reports
from hearthstat.sources import fixed_width, layouts, sinks, survey_view, tables
from hearthstat.workspace import session_space

from .fixed_width_files import write_fwf
from .oracles import OFFSET

ITEM_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def survey(spark: SparkSession, sf_dir: str) -> reports.Survey:
    return reports.Survey(
        items=survey_view.expense_items(spark, sf_dir),
        conditions=survey_view.living_conditions(spark, sf_dir),
        post_strata=survey_view.post_strata(spark, sf_dir),
        keys=survey_view.HOUSEHOLD,
        order=survey_view.ITEM_ORDER,
        post_strata_on=survey_view.HOUSEHOLD,
        null_safe=False,
        codes=survey_view.VIEW_CODES,
    )


def rounded(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    """Doubles rounded for comparison: ``digits`` unless a column names its own."""
    columns = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype == "double":
            c = F.round(c + OFFSET, other.get(name, digits)).alias(name)
        columns.append(c)
    return df.select(*columns)


def valued_items(s: reports.Survey, codes: str) -> DataFrame:
    return item_exprs.with_annual_amounts(products.items_in(s.items, s.codes[codes]))


def decile_design(spark, sf_dir, codes="fuel") -> Design:
    """Staged households with spending on ``codes`` and their income decile."""
    design = reports.staged_design(survey(spark, sf_dir), codes, False, session_space(spark))
    cuts = reports.income_cuts(design)
    return design.on(deciles.assign_decile(design.df, "renda_anual", cuts))


def placed(design: Design) -> Design:
    return design.on(design.df.filter(F.col("decil").isNotNull()))


def transport(spark, sf_dir, quirks="reference") -> reports.TransportBase:
    return reports.transport_base(survey(spark, sf_dir), session_space(spark), quirks)


def perception_rows(spark, sf_dir) -> DataFrame:
    s = survey(spark, sf_dir)
    rows = household.with_post_strata(
        s.conditions, s.post_strata, s.post_strata_on, s.null_safe
    )
    return deciles.assign_decile(rows, "renda_total", deciles.FIXED_CUTS)


def file_row(df: DataFrame) -> DataFrame:
    # The two-digit dwelling field cannot hold a customer key; V6102 / V9004 carry it.
    return df.withColumn("num_dom", F.col("household") % 100)


# Sources and sinks --------------------------------------------------------------------


@query
def s1_read_living_conditions(spark, sf_dir):
    path = session_space(spark).child("conditions.txt")
    rows = file_row(survey_view.living_conditions(spark, sf_dir))
    rows = rows.withColumn("v6102", F.col("household"))
    write_fwf(rows, path, layouts.LIVING_CONDITIONS)
    read = fixed_width.read_fwf(spark, path, layouts.LIVING_CONDITIONS)
    return read.select(
        "v6102", "uf", "estrato_pof", "cod_upa", "num_dom", "num_uc",
        "v61058", "peso", "peso_final", "renda_total",
    )


def expense_file(spark, sf_dir) -> str:
    path = session_space(spark).child("expenses.txt")
    rows = file_row(survey_view.expense_items(spark, sf_dir))
    rows = rows.withColumn("v9004", F.col("household") % 100000)
    write_fwf(rows, path, layouts.INDIVIDUAL_EXPENSES)
    return path


@query
def s2_read_expenses(spark, sf_dir):
    read = fixed_width.read_fwf(spark, expense_file(spark, sf_dir), layouts.INDIVIDUAL_EXPENSES)
    return read.select(
        "v9004", "uf", "estrato_pof", "cod_upa", "num_uc", "cod_informante", "v9001", "v9011",
        "fator_anualizacao", "v8000_defla", "deflator", "peso", "peso_final", "renda_total",
    )


@query
def s2_line_numbers(spark, sf_dir):
    """Lines numbered over all files and splits; the files are written in the order of the items."""
    path = session_space(spark).child("ordered.txt")
    rows = file_row(survey_view.expense_items(spark, sf_dir)).withColumn("v9004", F.col("household") % 100000)
    write_fwf(rows.orderBy(*ITEM_KEY), path, layouts.INDIVIDUAL_EXPENSES)
    read = fixed_width.read_fwf(spark, path, layouts.INDIVIDUAL_EXPENSES, file_order=True)
    return read.select("src_line", "v9004", "v9001", "cod_informante")


@query
def a7_first_line(spark, sf_dir):
    """The first line of each household in the order of the files."""
    path = session_space(spark).child("ordered_first.txt")
    rows = file_row(survey_view.expense_items(spark, sf_dir)).withColumn("v9004", F.col("household") % 100000)
    write_fwf(rows.orderBy(*ITEM_KEY), path, layouts.INDIVIDUAL_EXPENSES)
    read = fixed_width.read_fwf(spark, path, layouts.INDIVIDUAL_EXPENSES, file_order=True)
    keep = ("src_line", "v9001", "renda_total", "peso")
    return household.first_per_household(read, keep, ("v9004",), fixed_width.FILE_ORDER)


@query
def s3_problems_while_reading(spark, sf_dir):
    """Field problems counted by the pass that writes the items as a table."""
    path, space = expense_file(spark, sf_dir), session_space(spark)
    wrong = [layouts.Field(f.name, f.start, f.width, "int") if f.name == "deflator" else f for f in layouts.INDIVIDUAL_EXPENSES]
    problems = fixed_width.FieldProblems()
    space.stage(fixed_width.read_fwf(spark, path, wrong, problems=problems).select("v9001", "v9011"), "items")
    return problems.table(spark).filter(F.col("field").isin("v9011", "deflator", "v9001"))


@query
def s3_missing_values(spark, sf_dir):
    path = expense_file(spark, sf_dir)
    # "0" is declared missing here, besides blanks.
    read = fixed_width.read_fwf(spark, path, layouts.INDIVIDUAL_EXPENSES, na_strings=("0",))
    counted = ("v9011", "deflator", "num_uc", "uf", "v8000")
    return read.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in counted],
    )


@query
def s4_lower_names(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    upper = df.toDF(*[c.upper() for c in df.columns])
    return tables.lower_names(upper).select("c_custkey", "c_nationkey", "c_mktsegment")


@query
def s5_save_table(spark, sf_dir):
    path = session_space(spark).child("conditions")
    tables.save_table(survey_view.living_conditions(spark, sf_dir), path, ("uf",))
    saved = tables.load_table(spark, path)
    return saved.groupBy("uf").agg(F.count(F.lit(1)).alias("n"), F.sum("peso").alias("peso"))


@query
def s6_load_table(spark, sf_dir):
    path = session_space(spark).child("conditions")
    tables.save_table(survey_view.living_conditions(spark, sf_dir), path)
    return tables.load_table(spark, path).select(
        "household", "estrato_pof", "cod_upa", "peso", "renda_total"
    )


@query
def s8_write_report(spark, sf_dir):
    space = session_space(spark)
    report = reports.spend_by_decile(survey(spark, sf_dir), space)
    path = space.child("report")
    sinks.write_report(report.all_sheets(), path)
    names = list(report.sheets)
    first, second = (sinks.read_sheet(spark, path, n).withColumn("sheet", F.lit(n)) for n in names)
    return rounded(first.unionByName(second))


@query
def s9_write_csv2(spark, sf_dir):
    path = session_space(spark).child("total_dif.csv")
    total = svy_total(transport(spark, sf_dir).below_median(), "valor_total")
    sinks.write_csv2(total, path)
    return rounded(sinks.read_csv2(spark, path, total.schema), 3, se=0)


# Projections --------------------------------------------------------------------------


@query
def p1_ids_to_string(spark, sf_dir):
    rows = item_exprs.ids_to_string(survey_view.living_conditions(spark, sf_dir))
    return rows.select("household", "cod_upa", "num_dom", "num_uc")


@query
def p2_household_id(spark, sf_dir):
    rows = survey_view.living_conditions(spark, sf_dir)
    return rows.select("household", item_exprs.household_id().alias("domicilio_id"))


@query
def p3_person_id(spark, sf_dir):
    rows = survey_view.expense_items(spark, sf_dir)
    return rows.groupBy(item_exprs.person_id().alias("morador_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def p4_annual_value(spark, sf_dir):
    rows = survey_view.expense_items(spark, sf_dir)
    return rounded(rows.select(*ITEM_KEY, item_exprs.annual_value().alias("gasto")))


@query
def p5_annual_income(spark, sf_dir):
    rows = survey_view.expense_items(spark, sf_dir)
    return rounded(rows.select(*ITEM_KEY, item_exprs.annual_income().alias("renda_anual")))


@query
def p6_analysis_columns(spark, sf_dir):
    return survey_view.living_conditions(spark, sf_dir).select(
        "estrato_pof", "uf", "cod_upa", item_exprs.household_id().alias("domicilio_id"),
        "v61058", "peso", "peso_final", "renda_total",
    )


@query
def p7_income_decile(spark, sf_dir):
    return decile_design(spark, sf_dir).df.select("household", "decil")


@query
def p8_fixed_cut_decile(spark, sf_dir):
    return perception_rows(spark, sf_dir).select("household", "decil")


@query
def p9_decile_levels(spark, sf_dir):
    counts = perception_rows(spark, sf_dir).groupBy("decil").agg(F.count(F.lit(1)).alias("n"))
    dim = deciles.decile_dim(spark)
    return dim.join(F.broadcast(counts), "decil", "left").fillna(0, subset=["n"])


@query
def p10_gap_to_median(spark, sf_dir):
    base = transport(spark, sf_dir)
    national = base.below_median().df.select(F.lit(0).alias("decil"), "household", "valor_total")
    own = thresholds.below(base.with_decile_median().df, "gasto_total")
    own = own.select("decil", "household", thresholds.gap("gasto_total").alias("valor_total"))
    return rounded(national.unionByName(own))


@query
def p11_gap_to_half_median(spark, sf_dir):
    return rounded(transport(spark, sf_dir).below_half().df.select("household", "decil", "valor_total"))


@query
def p12_constant_one(spark, sf_dir):
    design = reports.base_design(survey(spark, sf_dir), "all", True)
    return point_estimates(design, {"total": ("total", 1.0)})


# Filters ------------------------------------------------------------------------------


def filtered_items(spark, sf_dir, codes):
    s = survey(spark, sf_dir)
    return products.items_in(s.items, s.codes[codes]).select(*ITEM_KEY[:3], "v9001")


@query
def f1_fuel_items(spark, sf_dir):
    return filtered_items(spark, sf_dir, "fuel")


@query
def f2_public_items(spark, sf_dir):
    return filtered_items(spark, sf_dir, "public")


@query
def f3_all_items(spark, sf_dir):
    return filtered_items(spark, sf_dir, "all")


@query
def f4_answer_groups(spark, sf_dir):
    rows = survey_view.living_conditions(spark, sf_dir)
    answers = rows.filter(F.col("v61058").isin(*reports.ANSWERS.values()))
    return answers.groupBy("v61058").agg(
        F.count(F.lit(1)).alias("n"), F.sum("peso").alias("peso")
    )


def decile_sizes(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.col("decil").isNotNull())
    return rows.groupBy("decil").agg(F.count(F.lit(1)).alias("n"), F.sum("peso").alias("peso"))


@query
def f5_decile_groups(spark, sf_dir):
    return decile_sizes(decile_design(spark, sf_dir).df)


@query
def f6_below_median(spark, sf_dir):
    return rounded(transport(spark, sf_dir).below_median().df.select("household", "gasto_total"))


@query
def f7_below_decile_median(spark, sf_dir):
    rows = transport(spark, sf_dir).with_decile_median().df
    return rounded(thresholds.below(rows, "gasto_total").select("household", "decil", "gasto_total"))


@query
def f8_decile_median_side(spark, sf_dir):
    rows = transport(spark, sf_dir).with_decile_median().df
    kept = thresholds.below(rows, "gasto_total", top_decile_above=True)
    return rounded(kept.select("household", "decil", "gasto_total"))


@query
def f9_below_half_median(spark, sf_dir):
    return rounded(transport(spark, sf_dir).below_half().df.select("household", "gasto_total"))


@query
def f10_decile_below_half_median(spark, sf_dir):
    return decile_sizes(transport(spark, sf_dir).below_half().df)


# Joins --------------------------------------------------------------------------------


@query
def j1_post_strata(spark, sf_dir):
    base = reports.base_design(survey(spark, sf_dir), "fuel", False).df
    return rounded(base.select("household", "pos_estrato", "gasto_total", "peso_final"))


@query
def j2_post_strata_again(spark, sf_dir):
    s = survey(spark, sf_dir)
    base = reports.base_design(s, "fuel", False).df
    again = household.with_post_strata(base, s.post_strata)
    return rounded(again.select("household", "pos_estrato", "gasto_total", "peso_final"))


@query
def j3_decile_threshold(spark, sf_dir):
    rows = transport(spark, sf_dir).with_decile_median().df
    return rounded(rows.select("household", "decil", "gasto_total", "threshold"))


# Unweighted aggregates ----------------------------------------------------------------


@query
def a1_answer_frequency(spark, sf_dir):
    return frequency.freq(survey_view.living_conditions(spark, sf_dir), "v61058")


@query
def a2_answer_by_decile(spark, sf_dir):
    return frequency.crosstab(perception_rows(spark, sf_dir), "v61058", "decil", range(1, 11))


@query
def a3_population_totals(spark, sf_dir):
    return population_totals(reports.base_design(survey(spark, sf_dir), "fuel", False).df)


@query
def a4_plain_means(spark, sf_dir):
    rows = decile_design(spark, sf_dir).df
    return rounded(frequency.mean_by(rows, "decil", ["renda_anual", "gasto_total"]))


@query
def a5_household_total(spark, sf_dir):
    s = survey(spark, sf_dir)
    return rounded(household.household_total(valued_items(s, "all"), keys=s.keys))


@query
def a6_household_total_plus_one(spark, sf_dir):
    s = survey(spark, sf_dir)
    rows = valued_items(s, "all")
    return rounded(household.household_total(rows, keys=s.keys, quirk_plus_one=True))


@query
def a7_first_row(spark, sf_dir):
    s = survey(spark, sf_dir)
    keep = ("estrato_pof", "uf", "cod_upa", "renda_anual", "peso")
    rows = valued_items(s, "fuel")
    return rounded(household.first_per_household(rows, keep, s.keys, s.order))


# Designs ------------------------------------------------------------------------------


@query
def e1_design_strata(spark, sf_dir):
    design = reports.base_design(survey(spark, sf_dir), "all", True)
    return design.strata_table()


@query
def e2_design_check(spark, sf_dir):
    return reports.base_design(survey(spark, sf_dir), "all", True).missing()


@query
def e3_lonely_psu(spark, sf_dir):
    design = reports.staged_design(survey(spark, sf_dir), "fuel", False, session_space(spark))
    parts = [
        svy_total(Design(design.df, lonely_psu=p), "gasto_total").withColumn("lonely_psu", F.lit(p))
        for p in ("adjust", "uncentred")
    ]
    return rounded(parts[0].unionByName(parts[1]), 3, se=0)


@query
def e4_post_stratified_weights(spark, sf_dir):
    design = post_stratify(Design(perception_rows(spark, sf_dir)), within=["v61058"])
    return rounded(design.df.select("household", "v61058", "peso_calibrado"), 6)


@query
def e5_families_by_decile(spark, sf_dir):
    levels = deciles.decile_dim(spark).select("decil")
    return frequency.svy_table(Design(perception_rows(spark, sf_dir)), "decil", levels)


@query
def e6_families_by_answer(spark, sf_dir):
    return frequency.svy_table(Design(survey_view.living_conditions(spark, sf_dir)), "v61058")


@query
def e7_calibrated_by_answer(spark, sf_dir):
    design = Design(perception_rows(spark, sf_dir))
    return rounded(frequency.calibrated_table(design, "decil", "v61058"))


# Estimates ----------------------------------------------------------------------------


@query
def e8_families(spark, sf_dir):
    base = transport(spark, sf_dir)
    below = thresholds.attach_threshold(base.design.df, base.median)
    both = svy_estimates(
        base.design.on(below),
        {"estimate": ("total", 1.0), "below": ("total", F.when(thresholds.is_below("gasto_total"), 1.0).otherwise(0.0))},
    )
    return rounded(both.select("estimate", F.col("estimate_se").alias("se"), "below"))


@query
def e9_families_by_decile(spark, sf_dir):
    design = transport(spark, sf_dir).with_decile_median()
    side = thresholds.is_below("gasto_total")
    measures = {"familias": ("total", 1.0), "familias_abaixo": ("total", 1.0, side)}
    return point_estimates(design, measures, ["decil"])


@query
def e10_total_gap(spark, sf_dir):
    return rounded(svy_total(transport(spark, sf_dir).below_median(), "valor_total"), 3, se=0)


@query
def e11_total_gap_by_decile(spark, sf_dir):
    poor = placed(transport(spark, sf_dir).below_half())
    return rounded(svy_total(poor, "valor_total", ["decil"]), 3, se=1)


@query
def e12_mean_income_by_decile(spark, sf_dir):
    return rounded(svy_mean(placed(decile_design(spark, sf_dir)), "renda_anual", ["decil"]))


@query
def e13_mean_spend_by_decile(spark, sf_dir):
    design = placed(decile_design(spark, sf_dir, "public"))
    return rounded(svy_mean(design, "gasto_total", ["decil"]))


@query
def e14_mean_spend_below(spark, sf_dir):
    design = transport(spark, sf_dir).with_decile_median()
    side = thresholds.is_below("gasto_total", top_decile_above=True)
    return rounded(
        point_estimates(design, {"gasto_medio": ("mean", "gasto_total", side)}, ["decil"])
    )


@query
def e15_mean_gap(spark, sf_dir):
    poor = placed(transport(spark, sf_dir).below_half())
    return rounded(svy_mean(poor, "valor_total", ["decil"]), se=3)


def quantiles(spark, sf_dir, codes, plus_one, column, probs):
    design = reports.staged_design(survey(spark, sf_dir), codes, plus_one, session_space(spark))
    return rounded(svy_quantile(design, column, probs))


@query
def e16_income_deciles(spark, sf_dir):
    return quantiles(spark, sf_dir, "fuel", False, "renda_anual", PROBS)


@query
def e17_spend_deciles(spark, sf_dir):
    return quantiles(spark, sf_dir, "all", True, "gasto_total", PROBS)


@query
def e18_median_spend(spark, sf_dir):
    return quantiles(spark, sf_dir, "all", True, "gasto_total", [0.5])


@query
def e19_median_spend_by_decile(spark, sf_dir):
    design = placed(transport(spark, sf_dir).design)
    return rounded(svy_quantile(design, "gasto_total", [0.5], ["decil"]))


@query
def e20_medians_below_half(spark, sf_dir):
    poor = transport(spark, sf_dir).below_half()
    rows = poor.df.withColumn("decil", F.coalesce("decil", F.lit(0)))
    medians = svy_quantile(poor.on(rows), ["gasto_total", "valor_total"], [0.5], ["decil"], whole=NATIONAL)
    return rounded(medians.drop("p"))


@query
def e21_standard_errors(spark, sf_dir):
    base = transport(spark, sf_dir)
    known = F.col("decil").isNotNull()
    parts = [
        svy_mean(base.design, "gasto_total", ["decil"], where=known, domain=domain).withColumn(
            "psus", F.lit(name)
        )
        for name, domain in (("subset", False), ("domain", True))
    ]
    return rounded(parts[0].unionByName(parts[1]), se=3)


@query
def e22_quantile_interval(spark, sf_dir):
    design = placed(transport(spark, sf_dir).design)
    return rounded(svy_quantile_ci(design, "gasto_total", [0.5], ["decil"]))


@query
def e22_national_interval(spark, sf_dir):
    """Median spend of families below half the median, with its interval, as the detail report prints it."""
    poor = transport(spark, sf_dir).below_half()
    return rounded(svy_quantile_ci(poor, "gasto_total", [0.25, 0.5]), se=3)


@query
def e23_svyby(spark, sf_dir):
    return rounded(svy_by(placed(decile_design(spark, sf_dir)), "gasto_total", ["decil"], "mean"))


# Windows and order --------------------------------------------------------------------


@query
def w1_total_on_items(spark, sf_dir):
    s = survey(spark, sf_dir)
    rows = household.total_on_items(valued_items(s, "fuel"), keys=s.keys)
    return rounded(rows.select(*ITEM_KEY, "household", "gasto_total"))


@query
def w2_first_item(spark, sf_dir):
    s = survey(spark, sf_dir)
    keep = ("l_orderkey", "l_linenumber", "l_partkey", "gasto")
    return rounded(household.first_per_household(valued_items(s, "all"), keep, s.keys, s.order))


@query
def w3_report_order(spark, sf_dir):
    report = reports.spend_by_decile(survey(spark, sf_dir), session_space(spark))
    sheet = report.sheet_tables()["Resultado_2"]
    # The position is read off the order in which the report's rows come.
    return rounded(sheet.withColumn("position", (F.monotonically_increasing_id() + 1).cast("int")))


# Reports ------------------------------------------------------------------------------


@query
def r1_stacked_deciles(spark, sf_dir):
    report = reports.spend_by_decile(survey(spark, sf_dir), session_space(spark), "public")
    return rounded(report.stacked(["media_renda", "media_gasto"]))


@query
def r2_deciles_and_total(spark, sf_dir):
    report = reports.half_median_totals(transport(spark, sf_dir))
    return rounded(report.sheet_tables()["Resultado_1"], 3)


@query
def r3_perception(spark, sf_dir):
    return rounded(reports.perception(survey(spark, sf_dir)).table)


@query
def r4_fuel_spend(spark, sf_dir):
    return rounded(reports.spend_by_decile(survey(spark, sf_dir), session_space(spark)).table)


@query
def r5_public_transport_spend(spark, sf_dir):
    return rounded(reports.spend_by_decile(survey(spark, sf_dir), session_space(spark), "public").table)


@query
def r6_decile_median(spark, sf_dir):
    return rounded(reports.families_below_decile_median(transport(spark, sf_dir)).table)


@query
def r6_decile_median_fixed(spark, sf_dir):
    return rounded(reports.families_below_decile_median(transport(spark, sf_dir, "fixed")).table)


@query
def r7_decile_gap(spark, sf_dir):
    return rounded(reports.gap_to_decile_median(transport(spark, sf_dir)).table)


@query
def r8_half_median(spark, sf_dir):
    return rounded(reports.half_median_detail(transport(spark, sf_dir)).table)


@query
def r9_half_median_totals(spark, sf_dir):
    return rounded(reports.half_median_totals(transport(spark, sf_dir)).table, 3)


# National figures ---------------------------------------------------------------------


def national(report: reports.Report) -> DataFrame:
    return rounded(report.national, 2, se=0)


@query
def r6_national(spark, sf_dir):
    return national(reports.families_below_decile_median(transport(spark, sf_dir)))


@query
def r7_national(spark, sf_dir):
    return national(reports.gap_to_decile_median(transport(spark, sf_dir)))


@query
def r8_national(spark, sf_dir):
    return national(reports.half_median_detail(transport(spark, sf_dir)))


@query
def r8_national_medians(spark, sf_dir):
    return rounded(reports.half_median_detail(transport(spark, sf_dir)).extra["medianas"])


@query
def e4_null_post_strata(spark, sf_dir):
    """Calibrated frequencies in one pass and in two, where some post-strata are missing."""
    rows = perception_rows(spark, sf_dir)
    known = F.when(F.col("household") % 7 != 0, F.col("pos_estrato"))
    design = Design(rows.withColumn("pos_estrato", known))
    one = frequency.calibrated_table(design, "decil", "v61058").select("v61058", "decil", "freq")
    two = post_stratify(design, within=["v61058"])
    two = frequency.svy_table(two, ["v61058", "decil"]).withColumnRenamed("freq", "two_steps")
    return rounded(one.join(two, ["v61058", "decil"], "left"))


@query
def r8_unknown_amount(spark, sf_dir):
    """Half-median detail and totals where one amount is missing: unknown, not 0."""
    s = survey(spark, sf_dir)
    lost = F.when(F.col("household") != 1, F.col("v8000_defla"))
    s = replace(s, items=s.items.withColumn("v8000_defla", lost))
    base = reports.transport_base(s, session_space(spark))
    totals = reports.half_median_totals(base).table.withColumnRenamed("decil", "d")
    detail = reports.half_median_detail(base).table.select("decil", "familias", "gasto_medio")
    return rounded(detail.join(totals, F.col("decil") == F.col("d")).drop("d"))


@query
def s3_field_problems(spark, sf_dir):
    path = expense_file(spark, sf_dir)
    wrong = [layouts.Field(f.name, f.start, f.width, "int") if f.name == "deflator" else f for f in layouts.INDIVIDUAL_EXPENSES]
    found = fixed_width.field_problems(spark, path, wrong)
    return found.filter(F.col("field").isin("v9011", "deflator", "v9001"))
