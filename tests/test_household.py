import pytest
from pyspark.sql import functions as F

from hearthstat.operators.first_row import RowOrder
from hearthstat.operators.household import (
    FIRST_ROW_ORDER,
    first_per_household,
    household_base,
    household_total,
    total_on_items,
    with_post_strata,
)
from hearthstat.sources.fixed_width import FILE_ORDER

SCHEMA = "cod_upa int, num_dom int, num_uc int, seq int, gasto double, renda_anual double"
ROWS = [
    (1, 1, 1, 2, 50.0, 20.0),
    (1, 1, 1, 1, 100.0, 10.0),
    (1, 1, 2, 1, 100.0, 30.0),
    (1, 1, 2, 2, None, 40.0),
    (1, None, 1, 1, 7.0, 50.0),
]
OPTIONS = dict(keep=("renda_anual",), order=("seq",))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_key(df, value):
    return {(r.num_dom, r.num_uc): r[value] for r in df.collect()}


def test_totals(items):
    assert by_key(household_total(items), "gasto_total") == {(1, 1): 150, (1, 2): None, (None, 1): 7}
    quirk = household_total(items, quirk_plus_one=True)
    assert by_key(quirk, "gasto_total") == {(1, 1): 151, (1, 2): None, (None, 1): 8}


def test_first_row(items):
    first = first_per_household(items, ("renda_anual",), order=("seq",))
    assert by_key(first, "renda_anual") == {(1, 1): 10, (1, 2): 30, (None, 1): 50}


def test_base_is_both_in_one_shuffle(items):
    base = household_base(items, **OPTIONS)
    assert by_key(base, "gasto_total") == by_key(household_total(items), "gasto_total")
    assert by_key(base, "renda_anual") == {(1, 1): 10, (1, 2): 30, (None, 1): 50}
    plan = household_base(items, **OPTIONS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_row_order_and_partitions_do_not_matter(items):
    expected = sorted(map(str, household_base(items, **OPTIONS).collect()))
    for other in (items.orderBy(F.desc("seq")), items.repartition(5)):
        assert sorted(map(str, household_base(other, **OPTIONS).collect())) == expected


def test_totals_on_items(items):
    rows = total_on_items(items)
    assert rows.count() == len(ROWS)
    assert {(r.num_dom, r.num_uc, r.gasto_total) for r in rows.collect()} == {
        (1, 1, 150.0), (1, 2, None), (None, 1, 7.0),
    }


def test_a_third_of_all_items_in_one_household(spark):
    """A hot household reaches the shuffle as one row per map task."""
    items = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("household"),
        F.col("id").alias("seq"),
        F.lit(1.0).alias("gasto"),
        F.col("id").cast("double").alias("renda_anual"),
    )
    base = household_base(items, keys=["household"], **OPTIONS)
    hot = base.filter("household = 0").first()
    assert (hot.gasto_total, hot.renda_anual, base.count()) == (10000.0, 0.0, 20001)
    assert "partial_min_by" in base._jdf.queryExecution().executedPlan().toString()


def test_post_strata_join(spark, items):
    ps = spark.createDataFrame(
        [(1, 1, "P"), (1, None, "Q"), (9, 9, "R")], "cod_upa int, num_dom int, pos_estrato string"
    )
    base = household_base(items, **OPTIONS)
    assert by_key(with_post_strata(base, ps), "pos_estrato") == {(1, 1): "P", (1, 2): "P", (None, 1): "Q"}
    plain = with_post_strata(base, ps, null_safe=False)
    assert by_key(plain, "pos_estrato") == {(1, 1): "P", (1, 2): "P"}
    # All columns shared: the join changes nothing.
    again = with_post_strata(with_post_strata(base, ps), ps)
    assert again.count() == 3


def test_post_strata_join_runs_nothing_when_built(spark, items):
    """The check of the keys rides on the join: no job before the first action."""
    ps = spark.createDataFrame([(1, "P")], "cod_upa int, pos_estrato string")
    base = household_base(items, **OPTIONS)
    spark.sparkContext.setJobGroup("building", "no job may start")
    joined = with_post_strata(base, ps)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert joined.count() == 3


def test_post_strata_must_be_unique(spark, items):
    ps = spark.createDataFrame([(1, "P"), (1, "Q")], "cod_upa int, pos_estrato string")
    base = household_base(items, **OPTIONS)
    with pytest.raises(Exception, match="more than one row for the same cod_upa"):
        with_post_strata(base, ps).collect()
    with pytest.raises(Exception, match="more than one row"):
        with_post_strata(base, ps).count()
    with pytest.raises(Exception, match="more than one row"):
        with_post_strata(base, ps, null_safe=False).select("renda_anual").collect()
    with pytest.raises(ValueError, match="share no column"):
        with_post_strata(base, ps.withColumnRenamed("cod_upa", "other"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ORDERED = "cod_upa int, num_dom int, num_uc int, a int, b int, c long, d date, e short, gasto double, renda_anual double, peso double"


def ordered_items(spark, n=400):
    """Households of many rows with ties, NULLs and extreme values in every order column."""
    import datetime
    import random

    rnd = random.Random(3)
    ints, longs = [None, -(2**31), -1, 0, 1, 2, 2**31 - 1], [None, -(2**63), 0, 5, 2**63 - 1]
    dates = [None, datetime.date(1, 1, 1), datetime.date(1970, 1, 1), datetime.date(2024, 2, 29)]
    rows = [
        (rnd.randrange(9), 1, 1, rnd.choice(ints), rnd.choice(ints), rnd.choice(longs), rnd.choice(dates), rnd.choice([None, -5, 7]), 1.0, rnd.choice([None, 1.5, float(i)]), float(i % 3))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ORDERED)


@pytest.mark.parametrize("order", (("a",), ("a", "b"), ("c",), ("d", "e"), ("e", "a"), ("a", "b", "c", "d"), ("c", "a", "b")))
def test_first_row_by_hash_equals_first_row_by_sort(spark, order):
    """NULLs first and ties alike, whatever number of order columns and whichever plan."""
    items = ordered_items(spark)
    keep = ("renda_anual", "peso", "a", "b")
    short = first_per_household(items, keep, order=order)
    # A text column of one value changes nothing but the plan.
    sorted_ = first_per_household(items.withColumn("none", F.lit("x")), keep, order=("none", *order))
    assert sorted(map(str, short.collect())) == sorted(map(str, sorted_.collect()))
    assert sorted(map(str, first_per_household(items.repartition(7), keep, order=order).collect())) == sorted(map(str, short.collect()))
    assert "SortAggregate" in plan_of(sorted_)
    assert ("SortAggregate" in plan_of(short)) == (order in (("a", "b", "c", "d"), ("c", "a", "b")))


def test_nulls_come_first_for_one_and_for_many_columns(spark):
    rows = [(1, 1, 1, None, 0, 5.0), (1, 1, 1, 2, 0, 6.0)]
    items = spark.createDataFrame(rows, "cod_upa int, num_dom int, num_uc int, o int, z int, renda_anual double")
    for order in (("o",), ("o", "z"), ("z", "o")):
        assert [r.renda_anual for r in first_per_household(items, ("renda_anual",), order=order).collect()] == [5.0]


def test_declared_digits(spark):
    order = RowOrder(("seq", "v"), {"seq": 2, "v": 7})
    schema = "cod_upa int, num_dom int, num_uc int, seq int, v int, renda_anual double"
    rows = [(1, 1, 1, 99, 0, 1.0), (1, 1, 1, 98, 9_999_999, 2.0), (1, 1, 1, 98, 9_999_998, 3.0), (2, 1, 1, 0, None, 4.0), (2, 1, 1, 0, 0, 5.0)]
    first = first_per_household(spark.createDataFrame(rows, schema), ("renda_anual",), order=order)
    assert sorted((r.cod_upa, r.renda_anual) for r in first.collect()) == [(1, 3.0), (2, 4.0)]
    assert "HashAggregate" in plan_of(first) and "SortAggregate" not in plan_of(first)
    for wrong in (100, -1):
        broken = spark.createDataFrame([(1, 1, 1, wrong, 0, 1.0)], schema)
        with pytest.raises(Exception, match="seq has more than 2 digits"):
            first_per_household(broken, ("renda_anual",), order=order).collect()


def test_default_orders_do_not_sort(spark):
    """The layout's order and the order of lines: hash aggregation from end to end."""
    columns = "id % 9 as cod_upa, id % 2 as num_dom, 1 as num_uc, 1.0D as gasto, cast(id as double) as renda_anual, id as src_line"
    ids = "cast(1 as int) as cod_informante, cast(23 as int) as quadro, cast(id % 90 as int) as seq, cast(2300401 as int) as v9001"
    items = spark.range(90).selectExpr(*columns.split(", "), *ids.split(", "))
    for order in (FIRST_ROW_ORDER, FILE_ORDER):
        base = household_base(items, keep=("renda_anual",), order=order)
        assert "HashAggregate" in plan_of(base) and "SortAggregate" not in plan_of(base)
        assert {r.renda_anual for r in base.collect()} == {float(i) for i in range(18)}
