"""Decile codes from cut points, and the decile dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Probabilities as doubles built by 0.1 + k * 0.1.
PROBS = tuple(0.1 + k * 0.1 for k in range(10))

# Published monthly income cuts.
FIXED_CUTS = (1232.61, 1697.72, 2227.73, 2706.64, 3323.68, 4098.24, 5239.78, 6944.56, 10941.71)

NATIONAL = 11


def decile_code(column: str | Column, cuts: Sequence[float | None]) -> Column:
    """1..10 by nine upper-closed cuts; below 0, NULL, or with a missing cut: NULL."""
    x = F.col(column) if isinstance(column, str) else column
    edges = [F.lit(c).cast("double") for c in cuts[:9]]
    code = F.when((x >= 0) & (x <= edges[0]), 1)
    for k in range(1, 9):
        code = code.when((x > edges[k - 1]) & (x <= edges[k]), k + 1)
    return code.when(x > edges[8], 10)


def assign_decile(df: DataFrame, column: str, cuts: Sequence[float | None]) -> DataFrame:
    return df.withColumn("decil", decile_code(column, cuts))


def decile_label(code: Column) -> Column:
    return F.when(code == NATIONAL, F.lit("Total")).otherwise(
        F.concat(code.cast("string"), F.lit("º Decil"))
    )


def decile_dim(spark: SparkSession, national: bool = False) -> DataFrame:
    """``(decil, label)`` in report order; sort by the number, never by the label."""
    last = NATIONAL if national else 10
    return spark.range(1, last + 1, 1, 1).select(
        F.col("id").cast("int").alias("decil"), decile_label(F.col("id")).alias("label")
    )
