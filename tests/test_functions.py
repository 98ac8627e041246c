import pytest
from pyspark.sql import functions as F

from hearthstat.functions import deciles, products, thresholds
from hearthstat.functions.items import (
    annual_income,
    annual_value,
    household_id,
    ids_to_string,
    person_id,
)


def test_product_dimension(spark):
    rows = products.product_dim(spark).collect()
    assert len(rows) == len({r.code for r in rows}) == 37
    assert sum(r.category == "fuel" for r in rows) == 5
    assert [r.code for r in rows if not r.in_code_list] == [2300404]
    assert set(products.CODES["all"]) == set(products.CODES["fuel"]) | set(products.CODES["public"])


def test_items_in_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.range(2301390, 2301410).select(F.col("id").cast("int").alias("v9001")).write.parquet(path)
    kept = products.items_in(spark.read.parquet(path), "fuel")
    assert [r.v9001 for r in kept.collect()] == [2301401]
    assert "PushedFilters: [In(v9001" in kept._jdf.queryExecution().toString()


def test_annual_amounts(spark):
    df = spark.createDataFrame(
        [(10.0, 12, None, 1000.0, None), (10.0, 12, 3, 1000.0, 1.05), (None, 12, 3, None, 1.05)],
        "v8000_defla double, fator_anualizacao int, v9011 int, renda_total double, deflator double",
    )
    rows = df.select(annual_value().alias("v"), annual_income().alias("r")).collect()
    assert [r.v for r in rows] == [120.0, 360.0, None]
    assert [r.r for r in rows] == [12000.0, pytest.approx(12600.0), None]


def test_ids(spark):
    df = spark.createDataFrame(
        [(123456789, 1, 2, 3), (5, None, 1, 1)],
        "cod_upa long, num_dom int, num_uc int, cod_informante int",
    )
    rows = df.select(household_id().alias("h"), person_id().alias("p")).collect()
    assert [tuple(r) for r in rows] == [("12345678912", "123456789123"), ("5NA1", "5NA11")]
    assert dict(ids_to_string(df).dtypes)["cod_upa"] == "string"


CUTS = [float(10 * k) for k in range(1, 10)]


def test_decile_edges(spark):
    values = [-1.0, None, 0.0, 10.0, 10.5, 20.0, 90.0, 90.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r.decil for r in deciles.assign_decile(df, "x", CUTS).collect()]
    assert found == [None, None, 1, 1, 2, 2, 9, 10]
    unknown = deciles.assign_decile(df, "x", [None] * 9)
    assert {r.decil for r in unknown.collect()} == {None}


def test_decile_dimension(spark):
    rows = deciles.decile_dim(spark, national=True).collect()
    assert [r.decil for r in rows] == list(range(1, 12))
    assert (rows[0].label, rows[9].label, rows[10].label) == ("1º Decil", "10º Decil", "Total")


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 5.0), (10, 5.0), (10, 15.0), (3, 5.0)], "decil int, x double")
    own = spark.createDataFrame([(1, 10.0), (10, 10.0)], "decil int, threshold double")
    rows = thresholds.attach_threshold(df, own, "decil")
    assert rows.count() == 4
    plain = thresholds.below(rows, "x").select("decil", "x").collect()
    assert sorted(map(tuple, plain)) == [(1, 5.0), (10, 5.0)]
    published = thresholds.below(rows, "x", top_decile_above=True).select("decil", "x").collect()
    assert sorted(map(tuple, published)) == [(1, 5.0), (10, 15.0)]
    half = thresholds.attach_threshold(df, 10.0)
    assert thresholds.below(half, "x", 0.5).count() == 0
    assert {r.g for r in half.select(thresholds.gap("x", 0.5).alias("g")).collect()} == {0.0, -10.0}
    assert thresholds.below(thresholds.attach_threshold(df, None), "x").count() == 0
