"""Connected components by alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthstat.workspace import LOCAL_ROWS, hint_if

from .staging import forget, staged

TASK_ROWS = 10_000  # edges of a small round for each task


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``edges`` (columns a, b).

    Every round points nodes at smaller neighbours, so stars of any size shrink without any
    task holding one; the number of rounds grows with the logarithm of the longest path.
    The driver keeps a record of every stage and task, so rounds on few edges must not have many:
    of at most ``LOCAL_ROWS`` edges the smallest neighbours are broadcast, the edges stay in
    place, and what is shuffled is read by a task for every ``TASK_ROWS`` of them.
    """
    stars = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
        small = now.n <= LOCAL_ROWS
        fitted = (lambda df, tasks=max(1, -(-now.n // TASK_ROWS)): df.coalesce(tasks)) if small else (lambda df: df)
        if now == before or now.n == 0:
            break
        before, old = now, stars
        both = stars.union(stars.select("b", "a"))
        low = hint_if(fitted(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))), small)
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(stars.select("a", "b").join(low, "a").select("a", F.col("m").alias("b")))
        large = large.filter("a <> b")
        large = large if small else large.distinct()  # repeated edges change nothing and are never more than before
        least = fitted(large.groupBy("a").agg(F.min("b").alias("m")))
        pointed = large.join(hint_if(least, small), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        stars = staged(fitted(pointed.filter("a <> b").distinct()), "edges", collect=not small)
        forget(old)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(fitted(stars.select("b", "b").distinct()))
