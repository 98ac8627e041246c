"""Confidence intervals of weighted quantiles by inverting the distribution function."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import hint_if, local_if_small, same, session_space
from .design import Design
from .estimate import svy_estimates
from .quantile import _log_cell, _long, first_cells, merged_cells, svy_quantile

# Above this many degrees of freedom t quantiles come from a series in 1/df.
TABLED_DF = 100


def svy_quantile_ci(
    design: Design,
    col: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    alpha: float = 0.05,
    na_rm: bool = False,
) -> DataFrame:
    """``(by, p, quantile, ci_low, ci_high, se)``.

    The standard error of the share of rows at or below the quantile gives
    ``p -+ t * se``, with PSUs minus strata degrees of freedom; the quantiles there are
    the limits, and their distance over ``2 t`` is the standard error.

    All rows are read once, for weights by PSU and cell of values, which are written to the
    shared folder.  The quantile, the distribution function at it, its spread over PSUs and
    both limits come from that table and from the rows of single cells.
    """
    by = list(by)
    spread = psu_cells(design, col, by)
    cells = merged_cells(spread, by)
    quantiles = svy_quantile(design, col, probs, by, na_rm, cells=cells)
    table, small = local_if_small(quantiles.filter(F.col("quantile").isNotNull()))
    if table.isEmpty():
        return quantiles.select("*", *[_null(c) for c in ("ci_low", "ci_high", "se")])
    share = svy_estimates(
        design.on(_below(design, col, by, spread, table, small)), {"share": ("mean", "_below")}, [*by, "p"], with_df=True
    )
    t = t_quantile(1.0 - alpha / 2.0, F.col("df"))
    reach = t * F.col("share_se")
    sides = F.array(
        F.struct(F.lit("ci_low").alias("side"), F.greatest(F.col("p") - reach, F.lit(0.0)).alias("at")),
        F.struct(F.lit("ci_high").alias("side"), F.least(F.col("p") + reach, F.lit(1.0)).alias("at")),
    )
    wanted, _ = local_if_small(
        share.select(*by, F.col("p").alias("p0"), t.alias("_t"), F.inline(sides)).withColumnRenamed("at", "p")
    )
    limits = (
        svy_quantile(design, col, wanted, by, na_rm, cells=cells)
        .groupBy(*by, F.col("p0").alias("p"), "_t")
        .agg(
            F.max(F.when(F.col("side") == "ci_low", F.col("quantile"))).alias("ci_low"),
            F.max(F.when(F.col("side") == "ci_high", F.col("quantile"))).alias("ci_high"),
        )
        .withColumn("se", (F.col("ci_high") - F.col("ci_low")) / (2.0 * F.col("_t")))
        .drop("_t")
    )
    keyed = [*by, "p"]
    other = [f"_l_{k}" for k in keyed]
    limits = limits.withColumnsRenamed(dict(zip(keyed, other)))
    return quantiles.join(limits, same(quantiles, limits, keyed, other), "left").drop(*other)


def psu_cells(design: Design, col: str, by: Sequence[str]) -> DataFrame:
    """Staged ``(by, strata, psu, _cell, _w, _n, _lo, _hi)``: no more rows than the design, mostly far fewer."""
    keys = list(dict.fromkeys([*by, design.strata, design.psu]))
    rows = _long(design, col, keys)
    return session_space(design.df.sparkSession).stage(first_cells(rows, keys), "psu_cells")


def _below(design: Design, col: str, by, spread: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``_below``, 1 or 0, with weights, PSUs and strata, for every group and quantile of ``table``.

    Cells on either side of a quantile's cell count as a whole; only the rows of that cell
    are looked at one by one.
    """
    named = [f"_q_{k}" for k in by]
    points = table.withColumnsRenamed(dict(zip(by, named))).withColumn("_at", _log_cell(F.col("quantile")))
    keys = list(dict.fromkeys([*by, "p", design.strata, design.psu]))
    cells = spread.filter(F.col("_cell").isNotNull())
    far = same(cells, points, by, named) & (cells["_cell"] != points["_at"]) if by else cells["_cell"] != points["_at"]
    ahead = cells.join(hint_if(points, small), far).select(
        *keys, F.col("_w").alias(design.weight), F.when(F.col("_cell") < F.col("_at"), 1.0).otherwise(0.0).alias("_below")
    )
    rows = _long(design, col, list(dict.fromkeys([*by, design.strata, design.psu])))
    here = same(rows, points, [*by, "_cell"], [*named, "_at"])
    near = rows.join(hint_if(points, small), here).select(
        *keys, F.col("_w").alias(design.weight), F.when(F.col("_x") <= F.col("quantile"), 1.0).otherwise(0.0).alias("_below")
    )
    return ahead.unionByName(near)


def _null(name: str) -> Column:
    return F.lit(None).cast("double").alias(name)


def t_quantile(p: float, df: Column) -> Column:
    """Student t quantile for whole ``df``; NULL below 1."""
    table = F.array(*[F.lit(v) for v in _t_table(p)])
    z = _normal_quantile(p)
    series = (
        (z**3 + z) / 4.0,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96.0,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160.0,
    )
    large = F.lit(z)
    for k, a in enumerate(series, 1):
        large = large + a / F.pow(df.cast("double"), F.lit(float(k)))
    tabled = F.get(table, df.cast("int") - 1)
    return F.when(df > TABLED_DF, large).when(df >= 1, tabled)


@lru_cache(maxsize=None)
def _t_table(p: float) -> tuple[float, ...]:
    return tuple(_solve(lambda t, n=n: _t_cdf(t, n), p) for n in range(1, TABLED_DF + 1))


@lru_cache(maxsize=None)
def _normal_quantile(p: float) -> float:
    return _solve(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)), p)


def _t_cdf(t: float, n: int) -> float:
    """Finite trigonometric sum for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(n))
    sin, cos2 = math.sin(angle), math.cos(angle) ** 2
    if n % 2:
        term, total = math.cos(angle), 0.0
        for k in range(1, n // 2 + 1):
            total += term
            term *= cos2 * (2 * k) / (2 * k + 1)
        return 0.5 + (angle + sin * total) / math.pi
    term, total = 1.0, 0.0
    for k in range(1, n // 2 + 1):
        total += term
        term *= cos2 * (2 * k - 1) / (2 * k)
    return 0.5 + sin * total / 2.0


def _solve(cdf, p: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2.0
