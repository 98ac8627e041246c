"""Numbers in a global order without a task that sees all rows.

Rows are counted part by part; a running sum over these counts, one row for each part,
says how many rows stand before a part.  Within its part a row knows its place already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import Workspace, hint_if, local_if_small

# The lower bits of Spark's increasing ids count the rows of a task.
ROW_BITS = 33


def row_in_task() -> Column:
    """0, 1, 2 ... along the rows of a task."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def starts(amounts: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``amounts`` with the sum of all earlier rows' ``amount`` as ``name``.

    One row for each part: a file split or a partition, never a row of data.
    """
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return amounts.withColumn(name, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def with_position(df: DataFrame, order: Sequence[Column], space: Workspace, column: str = "position") -> DataFrame:
    """``df`` with 1, 2, 3 ... along ``order`` as ``column``.

    Range partitions are sorted and written once, so that parts and places stay what they
    are when a task runs again.  Rows equal in all of ``order`` get numbers in any order; so
    that many equal rows spread over tasks, their place in the input counts last.
    """
    spread = "_spread"
    while spread in df.columns:
        spread += "_"
    keys = [*order, F.col(spread)]
    sorted_ = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = sorted_.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("part"), row_in_task().alias("place"))
    staged = space.stage(parts, "positions")
    counts = staged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before, small = local_if_small(starts(counts, ["part"], "rows", "before").drop("rows"))
    joined = staged.join(hint_if(before, small), "part")
    return joined.select("row.*", (F.col("before") + F.col("place") + 1).alias(column))
