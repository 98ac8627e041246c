"""Comparison with a median: thresholds on rows, sides, shortfalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import hint_if, local_if_small


def attach_threshold(df: DataFrame, threshold: float | None | DataFrame, by=None) -> DataFrame:
    """Add ``threshold``: one number for all rows, or ``(by, threshold)`` rows by group.

    Rows of a group without a threshold get NULL and so fall on neither side.
    """
    if by is None:
        return df.withColumn("threshold", F.lit(threshold).cast("double"))
    table, small = local_if_small(threshold.select(by, "threshold"))
    return df.join(hint_if(table, small), by, "left")


def is_below(column: str, factor: float = 1.0, top_decile_above: bool = False) -> Column:
    """Strictly below ``factor * threshold``.

    ``top_decile_above`` keeps the opposite side in decile 10, as the published
    decile-median report does.
    """
    x, limit = F.col(column), _scaled(factor)
    if not top_decile_above:
        return x < limit
    return F.when(F.col("decil") == 10, x > limit).otherwise(x < limit)


def below(df: DataFrame, column: str, factor: float = 1.0, top_decile_above: bool = False) -> DataFrame:
    return df.filter(is_below(column, factor, top_decile_above))


def gap(column: str, factor: float = 1.0) -> Column:
    """Shortfall to ``factor * threshold``."""
    return _scaled(factor) - F.col(column)


def _scaled(factor: float) -> Column:
    return F.col("threshold") if factor == 1.0 else F.col("threshold") * factor
