"""Hand-computed rows: four households, two strata, one of them with a single PSU."""

import pytest
from pyspark.sql import functions as F

from hearthstat.functions.thresholds import attach_threshold, gap, is_below
from hearthstat.operators.design import Design, calibration_factors, population_totals, post_stratify
from hearthstat.operators.estimate import point_estimates, svy_estimates, svy_mean, svy_total
from hearthstat.operators.frequency import calibrated_table, crosstab, freq, svy_table
from hearthstat.operators.quantile import svy_quantile

ROWS = [
    ("h1", "A", 1, 2.0, 3.0, "P", 10.0),
    ("h2", "A", 1, 1.0, 1.0, "P", 20.0),
    ("h3", "A", 2, 1.0, 2.0, "Q", 30.0),
    ("h4", "B", 3, 4.0, 6.0, "Q", 40.0),
]
SCHEMA = (
    "hh string, estrato_pof string, cod_upa int, peso double, peso_final double,"
    " pos_estrato string, gasto double"
)


@pytest.fixture(scope="module")
def design(spark):
    return Design(spark.createDataFrame(ROWS, SCHEMA))


def one(df):
    (row,) = df.collect()
    return row


def test_total_and_mean(design):
    assert one(svy_total(design, 1.0)).estimate == 8
    assert one(svy_total(design, "gasto")).estimate == 230
    assert one(svy_mean(design, "gasto")).estimate == 28.75


def test_quantiles_with_exact_tie(design):
    rows = svy_quantile(design, "gasto", [0.1, 0.5, 1.0]).orderBy("p").collect()
    assert [r.quantile for r in rows] == [10, 30, 40]


@pytest.mark.parametrize("policy, expected", [("adjust", 83.9312), ("uncentred", 160.3122)])
def test_lonely_psu(design, policy, expected):
    d = Design(design.df, lonely_psu=policy)
    assert one(svy_total(d, "gasto")).se == pytest.approx(expected, abs=1e-4)
    assert one(svy_mean(d, "gasto")).se == pytest.approx(8.1789, abs=1e-4)


def test_post_stratified_weights(design):
    calibrated = post_stratify(design)
    weights = [r.peso_calibrado for r in calibrated.df.orderBy("hh").collect()]
    assert weights == pytest.approx([8 / 3, 4 / 3, 1.6, 6.4])
    totals = {r.pos_estrato: r.freq for r in population_totals(design.df).collect()}
    sums = {r.pos_estrato: r.freq for r in svy_table(calibrated, "pos_estrato").collect()}
    assert sums == pytest.approx(totals)


def test_calibrated_table_equals_two_steps(design):
    rows = design.df.withColumn("answer", F.lit(1)).withColumn("level", F.col("cod_upa") % 2)
    d = design.on(rows)
    short = calibrated_table(d, "level", "answer").collect()
    steps = svy_table(post_stratify(d, within=["answer"]), ["answer", "level"]).collect()
    assert {r.level: r.freq for r in short} == pytest.approx({r.level: r.freq for r in steps})


def test_missing_post_strata_by_either_way(spark):
    """A cell half of known and half of missing strata counts its known half; one without any is not listed."""
    rows = [(1, 1, "P", 2.0, 6.0), (1, 1, None, 5.0, 5.0), (1, 2, None, 5.0, 5.0), (1, 3, "P", 1.0, 3.0), (1, 3, "Q", 4.0, None), (1, None, "P", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "answer int, level int, pos_estrato string, peso double, peso_final double")
    design = Design(df)
    expected = {1: 2 * 10 / 4, 3: 1 * 10 / 4}
    short = {r.level: r.freq for r in calibrated_table(design, "level", "answer").collect()}
    two = post_stratify(design, within=["answer"])
    assert short == {r.level: r.freq for r in svy_table(two, ["answer", "level"]).collect()} == pytest.approx(expected)
    assert two.df.count() == len(rows)
    factors = {r.pos_estrato: r.factor for r in calibration_factors(design, within=["answer"]).collect()}
    assert factors == {"P": 10 / 4, "Q": None, None: None}


def test_design_check_while_staging(spark, space, design):
    assert design.staged(space, "ok").df.count() == design.df.count()
    assert design.on(design.df.limit(0)).staged(space, "none").df.count() == 0
    broken = design.on(design.df.withColumn("peso", F.when(F.col("hh") != "h2", F.col("peso"))))
    with pytest.raises(ValueError, match="na_weight': 1"):
        broken.staged(space, "broken")


@pytest.mark.parametrize(
    "factor, families, total, mean", [(1.0, 3, 50, 50 / 3), (0.5, 2, 10, 5)]
)
def test_below_median(design, factor, families, total, mean):
    rows = attach_threshold(design.df, 30.0).withColumn("gap", gap("gasto", factor))
    low = design.on(rows.filter(is_below("gasto", factor)))
    row = one(svy_estimates(low, {"n": ("total", 1.0), "t": ("total", "gap"), "m": ("mean", "gap")}))
    assert (row.n, row.t, row.m) == (families, total, mean)


def test_missing_value_spoils_its_group_only(spark):
    rows = [r for r in ROWS[:3]] + [("h4", "B", 3, 4.0, 6.0, "Q", None)]
    d = Design(spark.createDataFrame(rows, SCHEMA))
    assert one(svy_mean(d, "gasto")).estimate is None
    assert one(svy_mean(d, "gasto", na_rm=True)).estimate == 17.5
    by = {r.estrato_pof: r for r in svy_mean(d, "gasto", ["estrato_pof"]).collect()}
    assert by["A"].estimate == 17.5 and by["B"].estimate is None
    quantiles = svy_quantile(d, "gasto", [0.5], ["estrato_pof"]).collect()
    assert {r.estrato_pof: r.quantile for r in quantiles} == {"A": 10, "B": None}
    skipped = svy_quantile(d, "gasto", [0.5], ["estrato_pof"], na_rm=True).collect()
    assert {r.estrato_pof: r.quantile for r in skipped} == {"A": 10, "B": None}
    assert one(point_estimates(d, {"m": ("mean", "gasto")})).m is None


def test_domain_keeps_empty_psus(design):
    here = F.col("gasto") < 30
    subset = one(svy_total(design, "gasto", where=here))
    domain = one(svy_total(design, "gasto", where=here, domain=True))
    assert subset.estimate == domain.estimate == 40
    # Stratum A: PSU sums 40 and 0; stratum B, of one PSU, is 0 against a mean of 40 / 3.
    assert domain.se == pytest.approx((2 / 1 * (20**2 + 20**2) + (40 / 3) ** 2) ** 0.5)


def test_design_check(spark, design):
    design.check()
    broken = design.on(design.df.withColumn("peso", F.when(F.col("hh") != "h2", F.col("peso"))))
    with pytest.raises(ValueError, match="na_weight"):
        broken.check()


def test_frequencies(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None), (None, 1)], "a int, d int")
    assert {r.a: r.freq for r in freq(df, "a").collect()} == {1: 2, 2: 1, None: 1}
    assert {r.a: r.freq for r in freq(df.dropna(), "a").collect()} == {1: 2, None: 0}
    table = {r.a: (r.d1, r.d2) for r in crosstab(df, "a", "d", [1, 2]).collect()}
    assert table == {1: (1, 1), 2: (0, 0)}


def test_scaling_weights(design):
    scaled = design.on(design.df.withColumn("peso", F.col("peso") * 3))
    a, b = (one(svy_estimates(d, {"t": ("total", "gasto"), "m": ("mean", "gasto")})) for d in (design, scaled))
    assert b.t == 3 * a.t and b.m == a.m
    assert b.t_se == pytest.approx(3 * a.t_se) and b.m_se == pytest.approx(a.m_se)
