"""A household-budget survey seen in the order tables, for tests and benchmarks.

Households are customers, items are order lines, PSUs and strata come from customer
columns.  Product codes are synthetic: 2300000 + part key modulo 40.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.first_row import RowOrder

HOUSEHOLD = ("household",)
ITEM_COLUMNS = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_extendedprice",
)
# The first four columns are unique.
ITEM_ORDER = RowOrder(
    ITEM_COLUMNS[:4],
    {"l_orderkey": 12, "l_linenumber": 2, "l_partkey": 12, "l_suppkey": 10},
    unique=True,
)

VIEW_FUEL = tuple(range(2300001, 2300006))
VIEW_PUBLIC = tuple(range(2300006, 2300038))
VIEW_CODES = {"fuel": VIEW_FUEL, "public": VIEW_PUBLIC, "all": VIEW_FUEL + VIEW_PUBLIC}

_FAMILY = {
    "estrato_pof": "c_nationkey",
    "uf": "c_nationkey % 5",
    "cod_upa": "case when c_nationkey % 5 = 0 then 0 else c_custkey % 4 end",
    "num_dom": "c_custkey",
    "num_uc": "case when c_custkey % 11 = 0 then null else c_custkey % 3 + 1 end",
    "peso": "cast(1 + c_custkey % 7 as double)",
    "peso_final": "cast((1 + c_custkey % 7) * (1 + c_nationkey % 3) as double)",
    "renda_total": "c_acctbal",
}
_ITEM = {
    "v9001": "2300000 + l_partkey % 40",
    "v8000_defla": "l_extendedprice",
    "fator_anualizacao": "case when l_partkey % 2 = 0 then 12 else 4 end",
    "v9011": "case when l_linenumber % 3 = 0 then null else l_linenumber end",
    "deflator": "case when l_returnflag = 'R' then null else 1.0e0 + l_discount end",
    "cod_informante": "l_linenumber",
}


# The columns used, so that no job is spent on reading file footers.
_SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _named(expressions: dict[str, str]):
    return [F.expr(e).alias(name) for name, e in expressions.items()]


def expense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item with its household's columns, like the expense file."""
    lines = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders")
    families = _table(spark, sf_dir, "customer").select("c_custkey", *_named(_FAMILY))
    return (
        lines.select(*ITEM_COLUMNS, *_named(_ITEM))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(families, F.col("o_custkey") == F.col("c_custkey"))
        .withColumnRenamed("o_custkey", "household")
        .drop("o_orderkey", "c_custkey")
    )


def living_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per interviewed family, like the living-conditions file."""
    families = _table(spark, sf_dir, "customer")
    return families.select(
        F.col("c_custkey").alias("household"),
        *_named(_FAMILY),
        F.expr("c_custkey % 5").alias("v61058"),
    )


def post_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(household, pos_estrato)``."""
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("household"), F.col("c_mktsegment").alias("pos_estrato")
    )
