"""Weighted quantiles: the smallest value whose cumulative weight share reaches p.

Spark has no percentile for fractional weights.  Sorting all rows is avoided:

1. Values fall into cells by an order-preserving rounding of their logarithm.  One
   aggregation gives weight, count, smallest and largest value per cell; its size
   depends on the spread of values, not on the number of rows.
2. A running sum over the cells shows in which cell each quantile lies.
3. While such a cell holds many rows and more than one value, only its rows are read
   again and cut into equal-width cells between its smallest and largest value.
4. Rows of the final cells are summed per distinct value and the running sum ends at
   the answer.

The answer is exact for every distribution; the cells only decide how much work each
task gets.  No group, hot or not, is gathered in one task: refinement goes on until every
cell is small or holds one value, for any number of groups.  The smallest and largest value
of a cell never share a finer one, so each refinement makes cells smaller.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import hint_if, local_if_small, local_rows, same, session_space
from .design import Design

# Cells per doubling of |x| + 1, equal-width cells of a refinement, rows a task may sort.
CELLS_PER_OCTAVE = 128
CELLS_PER_REFINEMENT = 4096
ROWS_PER_CELL = 1_000_000

# Relative tolerance of cumulative weight >= p * total.
RTOL = 1e-12

RULES = ("math",)


def svy_quantile(
    design: Design,
    cols: str | Sequence[str],
    probs: Sequence[float] | DataFrame,
    by: Sequence[str] = (),
    na_rm: bool = False,
    rtol: float = RTOL,
    rule: str = "math",
    rows_per_cell: int = ROWS_PER_CELL,
    whole: int | str | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """``(by, [variable], p, quantile)``.

    Several ``cols`` are handled in the same passes and named in ``variable``.
    ``probs`` is a list for every group, or a table of group columns, ``p`` and any
    further columns, which are kept in the result.  A NULL value makes the quantiles
    of its group NULL unless ``na_rm``; a NULL group is a group.  NaN counts as NULL.
    A probability asked twice is answered twice; without groups every probability has
    a row, NULL for a table without rows.  ``whole`` names one more level of the only ``by``
    column, of all rows: its cells are those of the groups added up, and no row is read for
    it again.  ``cells`` are ``first_cells`` of the same rows and columns, if at hand.

    Stage ``design.df`` first if it is costly to compute: it is read once per step.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    by = list(by)
    if whole is not None and len(by) != 1:
        raise ValueError("whole needs one group column")
    long = Values(_long(design, cols, by), by[0] if whole is not None else None, whole)
    groups = by if isinstance(cols, str) else [*by, "variable"]
    if cells is None:
        cells = first_cells(long.df, groups)
    if whole is not None:
        both = F.array(by[0], F.lit(whole).cast(cells.schema[by[0]].dataType))
        cells = merged_cells(cells.withColumn(by[0], F.explode(both)), groups)
    one_group = not groups and not isinstance(probs, DataFrame)
    found, rows = _evaluated(_first_cells(cells, groups, probs, na_rm, rtol), one_group)
    small = rows is not None
    while _still_large(found, rows, rows_per_cell):
        bounds = _bounds(found, rows, groups)
        finer = _refine(long, found, bounds, groups, small, rtol)
        # As many cells as before: what was local stays local, what was not is written again.
        found, rows = _evaluated(finer, proven=small, staged=not small)
    bounds = _bounds(found, rows, groups)
    answers = _last_values(long, found, bounds, groups, small, rtol)
    if one_group:
        return _in_order(answers, probs)
    if not isinstance(probs, DataFrame):
        answers = _repeated(answers, probs)
    return local_if_small(answers, proven=True)[0] if small else answers


@dataclass(frozen=True)
class Values:
    """Group columns, value, first-step cell and weight of the rows; which level of ``by`` holds all."""

    df: DataFrame
    by: str | None = None
    whole: int | str | None = None

    def belongs(self, bounds: DataFrame, keys: Sequence[str]) -> Column:
        """Whether a row is in the group and first-step cell of a bound; every row is in the whole."""
        others = [k for k in keys if k != self.by]
        cond = same(self.df, bounds, others, [f"_f_{k}" for k in others])
        if self.by is None:
            return cond
        theirs = bounds[f"_f_{self.by}"]
        return cond & (self.df[self.by].eqNullSafe(theirs) | F.coalesce(theirs == F.lit(self.whole), F.lit(False)))


def first_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _cell, _w, _n, _lo, _hi)``: weight, rows, least and largest value by cell of the logarithm."""
    return rows.groupBy(*keys, "_cell").agg(
        F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )


def merged_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of finer groups added up to those of ``keys``."""
    return cells.groupBy(*keys, "_cell").agg(
        F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )


def _in_order(answers: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row for each probability asked for, in its order."""
    values = {r["p"]: r["quantile"] for r in answers.collect()}
    rows = [(float(p), values.get(float(p))) for p in probs]
    return answers.sparkSession.createDataFrame(rows, "p double, quantile double")


def _repeated(answers: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Answers to probabilities asked for several times, as often."""
    times = {float(p): list(probs).count(p) for p in probs}
    for p, n in times.items():
        if n > 1:
            copies = F.when(F.col("p") == p, n).otherwise(1)
            answers = answers.withColumn("_k", F.explode(F.sequence(F.lit(1), copies))).drop("_k")
    return answers


def _evaluated(
    found: DataFrame, proven: bool = False, staged: bool = False
) -> tuple[DataFrame, pa.Table | None]:
    """A local table, or one written to the shared folder when the groups are too many."""
    rows = None
    if not staged:
        found, rows = local_rows(found, proven=proven)
    if rows is None:
        found = session_space(found.sparkSession).stage(found, "quantile_cells")
    return found, rows


def _long(design: Design, cols, by: list[str]) -> DataFrame:
    """Group columns, value, its first-step cell, and weight."""
    w = F.col(design.weight).cast("double").alias("_w")
    if isinstance(cols, str):
        x = _number(cols)
        return design.df.select(*by, x.alias("_x"), _log_cell(x).alias("_cell"), w)
    values = [
        F.struct(
            F.lit(c).alias("variable"),
            _number(c).alias("_x"),
            _log_cell(_number(c)).alias("_cell"),
        )
        for c in cols
    ]
    return design.df.select(*by, w, F.inline(F.array(*values)))


def _number(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _log_cell(x: Column) -> Column:
    # Never decreasing in x; NULL stays NULL, infinities land in the outermost cells.
    steps = F.floor(F.least(F.log2(F.abs(x) + 1.0), F.lit(1100.0)) * CELLS_PER_OCTAVE)
    return (F.signum(x) * steps).cast("int")


def _linear_cell(x: Column, lo: Column, hi: Column) -> Column:
    # Halves, since the distance of two doubles may be larger than any double.
    share = F.when(hi > lo, (x / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(0.0)
    return F.floor(F.nanvl(share, F.lit(1.0)) * CELLS_PER_REFINEMENT).cast("int")


def _first_cells(cells: DataFrame, groups, probs, na_rm: bool, rtol: float) -> DataFrame:
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("_cell").isNotNull()
    summed = cells.withColumns(
        {
            "_na": F.max(F.col("_cell").isNull()).over(whole) & F.lit(not na_rm),
            "_total": F.sum(F.when(known, F.col("_w"))).over(whole),
            "_cum": F.sum(F.when(known, F.col("_w"))).over(upto),
        }
    )
    summed, own = _with_probs(summed, groups, probs)
    goal = F.col("p") * F.col("_total")
    reached = known & (F.col("_cum") >= goal * (1.0 - rtol))
    here = F.struct("_cell", (F.col("_cum") - F.col("_w")).alias("_before"), "_lo", "_hi", "_n")
    return (
        summed.groupBy(*groups, *own)
        .agg(
            F.max("_na").alias("_na"),
            F.max(goal).alias("_goal"),
            F.min(F.when(reached, here)).alias("_at"),
        )
        .select(*groups, *own, "_na", "_goal", "_at.*")
    )


def _with_probs(cells: DataFrame, groups, probs) -> tuple[DataFrame, list[str]]:
    """Each cell once per probability wanted in its group, and the columns that came along."""
    if not isinstance(probs, DataFrame):
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return cells.withColumn("p", F.explode(wanted)), ["p"]
    own = [c for c in probs.columns if c not in groups]
    if not groups:
        rows = [F.struct(*[F.lit(r[c]).alias(c) for c in own]) for r in probs.collect()]
        return cells.select("*", F.inline(F.array(*rows))), own
    wanted, small = local_if_small(probs)
    other = [f"_p_{g}" for g in groups]
    wanted = wanted.withColumnsRenamed(dict(zip(groups, other)))
    joined = cells.join(hint_if(wanted, small), same(cells, wanted, groups, other))
    return joined.drop(*other), own


def _still_large(found: DataFrame, rows: pa.Table | None, rows_per_cell: int) -> bool:
    if rows is None:
        return not found.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > rows_per_cell)).isEmpty()
    cells = rows.filter(pc.less(rows["_lo"], rows["_hi"]))
    return bool(pc.any(pc.greater(cells["_n"], rows_per_cell)).as_py())


def _bounds(found: DataFrame, rows: pa.Table | None, groups) -> DataFrame:
    """The distinct cells found, with their keys renamed for the join."""
    keys = [*groups, "_cell", "_lo", "_hi"]
    if rows is None:
        cells = found.select(*keys).distinct()
    else:
        distinct = rows.select(keys).group_by(keys).aggregate([]).select(keys)
        cells = F.broadcast(found.sparkSession.createDataFrame(distinct, found.select(*keys).schema))
    return cells.withColumnsRenamed({k: f"_f_{k}" for k in keys[:-2]})


def _candidates(long: Values, bounds: DataFrame, groups) -> DataFrame:
    """Rows inside the cells found, one copy per cell, with the cell's bounds."""
    keys = [*groups, "_cell"]
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    found = long.df.join(bounds, long.belongs(bounds, keys) & inside)
    return found.select(*(F.col(f"_f_{k}").alias(k) for k in keys), "_lo", "_hi", "_x", "_w")


def _reached(parts: DataFrame, found, cell_keys, order: str, last: Column, small, rtol) -> DataFrame:
    """Parts of each cell from where the running weight meets the goal."""
    running = Window.partitionBy(*cell_keys).orderBy(order)
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        *[F.col(k).alias(f"_m_{k}") for k in cell_keys],
        *[c for c in parts.columns if c not in cell_keys],
        F.sum("_w").over(running).alias("_in"),
    )
    # Summed in another order than the cells, the weight may miss the goal by a rounding
    # error; the cell's last part then counts as reached.
    met = (F.col("_before") + F.col("_in") >= F.col("_goal") * (1.0 - rtol)) | last
    cond = same(parts, found, [f"_m_{k}" for k in cell_keys], cell_keys) & met
    return parts.join(hint_if(found, small), cond)


def _refine(long, found: DataFrame, bounds, groups, small: bool, rtol: float) -> DataFrame:
    cell_keys = [*groups, "_cell", "_lo", "_hi"]
    sub = _linear_cell(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_sub")
    parts = (
        _candidates(long, bounds, groups)
        .groupBy(*cell_keys, sub)
        .agg(
            F.sum("_w").alias("_w"),
            F.count(F.lit(1)).alias("_sub_n"),
            F.min("_x").alias("_sub_lo"),
            F.max("_x").alias("_sub_hi"),
        )
    )
    last = F.col("_sub_hi") == F.col("_hi")
    here = F.struct(
        "_sub",
        (F.col("_before") + F.col("_in") - F.col("_w")).alias("_before"),
        F.col("_sub_lo").alias("_lo"),
        F.col("_sub_hi").alias("_hi"),
        F.col("_sub_n").alias("_n"),
    )
    keep = [c for c in found.columns if c not in ("_before", "_lo", "_hi", "_n")]
    finer = (
        _reached(parts, found, cell_keys, "_sub", last, small, rtol)
        .groupBy(*cell_keys, *[c for c in keep if c not in cell_keys])
        .agg(F.min(here).alias("_at"))
        .select(*keep, "_at._before", "_at._lo", "_at._hi", "_at._n")
    )
    return finer.unionByName(found.filter(F.col("_cell").isNull()))


def _last_values(long, found: DataFrame, bounds, groups, small: bool, rtol: float) -> DataFrame:
    cell_keys = [*groups, "_cell", "_lo", "_hi"]
    values = (
        _candidates(long, bounds, groups)
        .groupBy(*cell_keys, "_x")
        .agg(F.sum("_w").alias("_w"))
    )
    last = F.col("_x") == F.col("_hi")
    internal = ("_na", "_goal", "_cell", "_before", "_lo", "_hi", "_n")
    out = [c for c in found.columns if c not in internal]
    answers = (
        _reached(values, found, cell_keys, "_x", last, small, rtol)
        .groupBy(*cell_keys, *[c for c in out if c not in groups])
        .agg(F.when(~F.max("_na"), F.min("_x")).alias("quantile"))
        .select(*out, "quantile")
    )
    nothing = found.filter(F.col("_cell").isNull())
    return answers.unionByName(nothing.select(*out, F.lit(None).cast("double").alias("quantile")))


def quantile_values(result: DataFrame) -> list[float | None]:
    """Quantiles of one group and variable as numbers, by growing ``p``."""
    return [r["quantile"] for r in sorted(result.collect(), key=lambda r: r["p"])]
