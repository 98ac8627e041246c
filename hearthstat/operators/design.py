"""Stratified cluster designs and post-stratified weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..workspace import Workspace, hint_if, local_if_small, same

LONELY_PSU = ("adjust", "uncentred")


@dataclass(frozen=True)
class Design:
    """A table plus the columns that describe how it was sampled.

    PSU ids are nested: the cluster key is (strata, psu).  ``lonely_psu`` says how a
    stratum with one PSU counts in a variance: ``adjust`` centres its sum on the mean
    of all PSU sums, ``uncentred`` on zero.
    """

    df: DataFrame
    psu: str = "cod_upa"
    strata: str = "estrato_pof"
    weight: str = "peso"
    lonely_psu: str = "adjust"

    def __post_init__(self):
        if self.lonely_psu not in LONELY_PSU:
            raise ValueError(f"lonely_psu must be one of {LONELY_PSU}")

    def on(self, df: DataFrame) -> "Design":
        """The same design declared on other rows."""
        return replace(self, df=df)

    def missing(self) -> DataFrame:
        """One row: rows in all, and rows without PSU, stratum or weight."""
        return self.df.agg(*self._counts())

    def _counts(self) -> list[Column]:
        return [
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(self.psu).isNull()).alias("na_psu"),
            F.count_if(F.col(self.strata).isNull()).alias("na_strata"),
            F.count_if(F.col(self.weight).isNull()).alias("na_weight"),
        ]

    def strata_table(self) -> DataFrame:
        """``(strata, psus, n, weight)``; PSU ids are counted inside their stratum."""
        psus = self.df.groupBy(self.strata, self.psu).agg(
            F.count(F.lit(1)).alias("n"), F.sum(self.weight).alias(self.weight)
        )
        return psus.groupBy(self.strata).agg(
            F.count(F.lit(1)).alias("psus"),
            F.sum("n").alias("n"),
            F.sum(self.weight).alias(self.weight),
        )

    def check(self) -> "Design":
        """Raise if a row has no PSU, stratum or weight; one pass over the rows."""
        return self._refuse(self.missing().first().asDict())

    def staged(self, space: Workspace, name: str) -> "Design":
        """The rows written once to the shared folder, and checked while they are written."""
        seen = Observation()
        table = space.stage(self.df.observe(seen, *self._counts()), name)
        return self.on(table)._refuse(seen.get)

    def _refuse(self, counts: dict) -> "Design":
        bad = {k: counts[k] for k in ("na_psu", "na_strata", "na_weight") if counts.get(k)}
        if bad:
            raise ValueError(f"missing values in the design: {bad}")
        return self


def population_totals(
    df: DataFrame, by: str = "pos_estrato", weight: str = "peso_final", within: Sequence[str] = ()
) -> DataFrame:
    """``(within, by, freq)``: population of each post-stratum; NULL rows are left out."""
    known = df.filter(F.col(by).isNotNull() & F.col(weight).isNotNull())
    return known.groupBy(*within, by).agg(F.sum(weight).alias("freq"))


def calibration_factor(by: str, population: Column, sample: Column) -> Column:
    """The one rule for the factor of a post-stratum: population over sample, NULL where ``by`` is.

    Rows without a post-stratum have no population (``population_totals`` leaves them out), so
    they are in no calibrated table, whichever way it is made.
    """
    return F.when(F.col(by).isNotNull(), population / sample)


def calibration_factors(
    design: Design, by: str = "pos_estrato", totals: DataFrame | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """``(within, by, factor)`` of every post-stratum of the sample; missing ones are a row of their own."""
    keys = [*within, by]
    if totals is None:
        totals = population_totals(design.df, by, within=within)
    ours = design.df.groupBy(*keys).agg(F.sum(design.weight).alias("_sample"))
    theirs = totals.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    joined = ours.join(theirs, same(ours, theirs, keys, [f"_t_{k}" for k in keys]), "left")
    return joined.select(*keys, calibration_factor(by, F.col("freq"), F.col("_sample")).alias("factor"))


def post_stratify(
    design: Design,
    by: str = "pos_estrato",
    totals: DataFrame | None = None,
    within: Sequence[str] = (),
) -> Design:
    """Scale weights so that they sum to ``totals`` in every post-stratum.

    ``within`` calibrates several subsets at once.  The factors are joined to the rows
    (broadcast if few) rather than taken over a window, so no task holds a whole
    post-stratum.  Rows without a post-stratum keep their place and have no weight.
    """
    keys = [*within, by]
    other = [f"_r_{k}" for k in keys]
    factors = calibration_factors(design, by, totals, within)
    factors, small = local_if_small(factors.withColumnsRenamed({**dict(zip(keys, other)), "factor": "_ratio"}))
    df = design.df.join(hint_if(factors, small), same(design.df, factors, keys, other))
    calibrated = df.withColumn("peso_calibrado", F.col(design.weight) * F.col("_ratio"))
    return replace(
        design,
        df=calibrated.drop("_ratio", *other),
        weight="peso_calibrado",
    )
