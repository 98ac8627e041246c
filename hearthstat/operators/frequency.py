"""Frequency tables, weighted and not, and plain group means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .design import Design, calibration_factor


def freq(df: DataFrame, column: str, use_na: bool = True) -> DataFrame:
    """``(column, freq)``; with ``use_na`` the NULL level is listed even when empty."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    if not use_na:
        return counts.filter(F.col(column).isNotNull())
    dtype = df.schema[column].dataType
    empty = df.sparkSession.range(1).select(
        F.lit(None).cast(dtype).alias(column), F.lit(0).cast("bigint").alias("freq")
    )
    return counts.unionByName(empty).groupBy(column).agg(F.sum("freq").alias("freq"))


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence, prefix: str = "d") -> DataFrame:
    """Counts of ``rows`` by the given ``columns`` levels; NULL is in neither margin."""
    wide = df.filter(F.col(rows).isNotNull()).groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(f"{prefix}{v}") for v in levels]
    )
    return wide


def mean_by(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Unweighted means, NULL values skipped; NULL is a group of its own."""
    return df.groupBy(by).agg(*[F.avg(c).alias(f"media_{c}") for c in columns])


def svy_table(
    design: Design, columns: str | Sequence[str], levels: DataFrame | None = None
) -> DataFrame:
    """``(columns, freq)``: weighted frequencies.

    Rows with a NULL level, and rows that calibration left without a weight, are left out;
    ``levels`` lists the levels wanted, with 0 where the sample has none.
    """
    keys = [columns] if isinstance(columns, str) else list(columns)
    df = design.df.dropna(subset=[*keys, design.weight])
    table = df.groupBy(*keys).agg(F.sum(design.weight).alias("freq"))
    if levels is None:
        return table
    return levels.join(table, keys, "left").fillna(0.0, subset=["freq"])


def calibrated_cells(
    design: Design,
    column: str,
    within: str,
    by: str = "pos_estrato",
    population: str = "peso_final",
) -> DataFrame:
    """``(within, by, column, freq, calibrated)``: plain and post-stratified weight sums.

    Calibration inside a ``within`` level scales weights by one factor per post-stratum,
    so the rows are read once and everything else happens on these few sums.  The factor's
    rule is that of ``post_stratify``: rows without a post-stratum belong to none, and their
    cells' calibrated weight is NULL.
    """
    cells = design.df.groupBy(within, by, column).agg(
        F.sum(design.weight).alias("freq"), F.sum(population).alias("_n")
    )
    stratum = Window.partitionBy(within, by)
    factor = calibration_factor(by, F.sum("_n").over(stratum), F.sum("freq").over(stratum))
    return cells.select(within, by, column, "freq", (F.col("freq") * factor).alias("calibrated"))


def calibrated_table(design: Design, column: str, within: str, **options) -> DataFrame:
    """``(within, column, freq)`` with weights post-stratified inside each ``within`` level.

    Equal to ``post_stratify`` followed by ``svy_table``: a cell counts its rows of known
    post-strata, and a cell without any is not listed.
    """
    cells = calibrated_cells(design, column, within, **options).dropna(subset=["calibrated"])
    table = cells.groupBy(within, column).agg(F.sum("calibrated").alias("freq"))
    return table.dropna(subset=[within, column])
