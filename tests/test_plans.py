"""What the physical plans must look like for large inputs."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import survey
from hearthstat.operators import quantile
from hearthstat.operators.design import Design
from hearthstat.operators.estimate import svy_estimates
from hearthstat.operators.frequency import calibrated_table
from hearthstat.operators.household import household_base
from hearthstat.plans import indicators as reports


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The adaptive plan as executed, without the initial plans it replaced."""
    df.collect()
    kept, skip_from = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :"))
        if skip_from is not None and depth > skip_from:
            continue
        skip_from = depth if "== Initial Plan ==" in line else None
        if skip_from is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture()
def households(spark, space):
    df = spark.range(2000).select(
        (F.col("id") % 7).alias("estrato_pof"),
        (F.col("id") % 40).alias("cod_upa"),
        (F.col("id") % 10 + 1).cast("int").alias("decil"),
        (F.col("id") % 5).alias("v61058"),
        (F.col("id") % 3).alias("pos_estrato"),
        F.col("id").cast("double").alias("gasto_total"),
        F.lit(2.0).alias("peso"),
        F.lit(3.0).alias("peso_final"),
        F.lit("unused").alias("other"),
    )
    return Design(space.stage(df, "households"))


@pytest.mark.parametrize("by", [[], ["decil"]])
def test_standard_errors_read_the_rows_once(households, by):
    text = final_plan(svy_estimates(households, {"m": ("mean", "gasto_total")}, by))
    assert len(re.findall(r"FileScan parquet", text)) == 1
    assert "ReusedExchange" in text
    assert "other" not in text and "Nested" not in text and "Cartesian" not in text


def test_calibrated_table_reads_the_rows_once(households):
    df = calibrated_table(households, "decil", "v61058")
    assert plan(df).count("FileScan parquet") == 1
    assert "HashAggregate" in plan(df)


def test_threshold_filter_reaches_the_scan(households):
    base = reports.TransportBase(households, 1000.0, "reference")
    assert "PushedFilters: [IsNotNull(gasto_total), LessThan(gasto_total,500.0)]" in plan(
        base.below_half().df
    )


def test_base_shuffles_once_per_key_without_broadcast(spark):
    """On tables too large to broadcast, joins and grouping share a partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = reports.base_design(survey(spark, "/root/testdata/sf0.001"), "fuel", False)
        text = plan(base.df)
        assert "Broadcast" not in text
        # Items and orders by order; their join, families and post-strata by household.
        assert text.count("Exchange hashpartitioning") == 5
        assert text.index("Filter (((l_partkey") > text.index("Exchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_household_is_split_in_the_join(spark, space):
    """A third of all items in one household: the join's partition is split by adaptive execution."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 300_000
        household = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 19_999 + 1)
        items = spark.range(0, n, 1, 8).select(
            household.alias("household"),
            F.col("id").alias("seq"),
            F.lit(2.0).alias("gasto"),
        )
        families = spark.range(20_000).select(
            F.col("id").alias("household"), F.col("id").cast("double").alias("renda_anual")
        )
        joined = space.stage(items, "items").join(space.stage(families, "families"), "household")
        base = household_base(joined, keep=("renda_anual",), keys=("household",), order=("seq",))
        assert "SortMergeJoin(skew=true)" in final_plan(base)
        hot = base.filter("household = 0").first()
        assert (hot.gasto_total, hot.renda_anual) == (2.0 * n / 3, 0.0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quantile_steps_read_value_and_weight_only(households):
    """Cells are merged before the shuffle; candidates meet the cells in a broadcast join."""
    seen = []
    whole = quantile.local_rows

    def spy(df, *args, **kwargs):
        seen.append(plan(df))
        return whole(df, *args, **kwargs)

    quantile.local_rows = spy
    try:
        quantile.svy_quantile(households, "gasto_total", [0.5], ["decil"]).collect()
    finally:
        quantile.local_rows = whole
    for text in seen:
        assert "ReadSchema: struct<decil:int,gasto_total:double,peso:double>" in text
        assert "partial_sum(_w" in text
        assert "Nested" not in text and "Cartesian" not in text


def test_the_whole_adds_up_cells_and_reads_each_row_once(households):
    """The level of all rows is made of merged cells: rows are not exploded, and scanned once a step."""
    seen = []
    whole = quantile.local_rows

    def spy(df, *args, **kwargs):
        seen.append(plan(df))
        return whole(df, *args, **kwargs)

    quantile.local_rows = spy
    try:
        answers = quantile.svy_quantile(households, "gasto_total", [0.5], ["decil"], whole=11)
        assert answers.count() == 11
    finally:
        quantile.local_rows = whole
    for text in seen:
        assert text.count("FileScan parquet") <= 1 and "Nested" not in text and "Cartesian" not in text
    first = seen[0].splitlines()
    explode = next(i for i, line in enumerate(first) if "Generate explode" in line)
    assert any("partial_sum(_w" in line for line in first[explode:])  # below it rows are merged to cells already


def test_design_check_has_no_pass_of_its_own(spark, households, space):
    """Missing design values are counted by the job that writes the base."""
    spark.sparkContext.setJobGroup("staging", "one write")
    households.staged(space, "again")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("staging")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
