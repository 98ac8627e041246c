"""From items to one row per household, and the join to post-strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.items import HOUSEHOLD_KEYS, ids_to_string
from ..sources.layouts import INDIVIDUAL_EXPENSES
from ..workspace import same
from .first_row import RowOrder, first_row

_WIDTHS = {f.name: f.width for f in INDIVIDUAL_EXPENSES}
FIRST_ROW_ORDER = RowOrder(
    ("cod_informante", "quadro", "seq", "v9001"),
    {c: _WIDTHS[c] for c in ("cod_informante", "quadro", "seq", "v9001")},
)
BASE_COLUMNS = ("estrato_pof", "uf", "renda_anual", "peso", "peso_final")


def na_sum(column: str | Column) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    x = F.col(column) if isinstance(column, str) else column
    return F.when(F.count_if(x.isNull()) == 0, F.sum(x))


def household_total(
    items: DataFrame, value: str = "gasto", keys=HOUSEHOLD_KEYS, quirk_plus_one: bool = False
) -> DataFrame:
    """``(keys, gasto_total)``; the quirk adds 1 to every household, as published."""
    return items.groupBy(*keys).agg(_total(value, quirk_plus_one).alias("gasto_total"))


def total_on_items(
    items: DataFrame, value: str = "gasto", keys=HOUSEHOLD_KEYS, quirk_plus_one: bool = False
) -> DataFrame:
    """Every item row with its household's ``gasto_total``.

    Totals are merged before the shuffle and joined back, where a window would gather
    all items of a household in one task.
    """
    totals = household_total(items, value, keys, quirk_plus_one)
    other = [f"_t_{k}" for k in keys]
    totals = totals.withColumnsRenamed(dict(zip(keys, other)))
    return items.join(totals, same(items, totals, keys, other)).drop(*other)


def first_per_household(
    items: DataFrame, keep: Sequence[str], keys=HOUSEHOLD_KEYS, order: RowOrder | Sequence[str] = FIRST_ROW_ORDER
) -> DataFrame:
    """The kept columns of each household's first row in ``order``, NULLs first."""
    firsts, kept = first_row(items, [c for c in keep if c not in keys], order)
    return items.groupBy(*keys).agg(*firsts).select(*keys, *kept)


def household_base(
    items: DataFrame,
    value: str = "gasto",
    keep: Sequence[str] = BASE_COLUMNS,
    keys=HOUSEHOLD_KEYS,
    order: RowOrder | Sequence[str] = FIRST_ROW_ORDER,
    quirk_plus_one: bool = False,
) -> DataFrame:
    """Household total and first row in one shuffle.

    Both parts merge before the shuffle, so a household with very many items
    sends one row per map task.  They merge by hash if ``order`` fits one number (see
    ``first_row``) and numbers are kept; kept text makes Spark sort first.
    """
    firsts, kept = first_row(items, [c for c in keep if c not in keys], order)
    grouped = items.groupBy(*keys).agg(_total(value, quirk_plus_one).alias("gasto_total"), *firsts)
    return grouped.select(*keys, "gasto_total", *kept)


def _total(value: str, quirk_plus_one: bool) -> Column:
    total = na_sum(value)
    return total + 1.0 if quirk_plus_one else total


def with_post_strata(
    df: DataFrame, ps: DataFrame, on: Sequence[str] | None = None, null_safe: bool = True
) -> DataFrame:
    """Inner join on every shared column (or ``on``); unmatched rows go.

    NULL keys match each other unless ``null_safe`` is off; plain equality lets Spark
    reuse a partitioning by the same keys.  A key that occurs twice in ``ps`` would
    multiply households, so it raises when the join runs, whatever is read of the result:
    the lookup is grouped by its keys first, by the same shuffle that the join needs, and a
    filter on the counts cannot be pruned.  Only a key that no task comes to read, behind the
    last household's, may go unnoticed.  Spark sizes the join: the lookup is broadcast only
    if it proves small.
    """
    keys = list(on) if on is not None else [c for c in df.columns if c in ps.columns]
    if not keys:
        raise ValueError("household table and post-strata share no column")
    # Ids may be numbers on one side and text on the other: compare both as text.
    ours, theirs = dict(df.dtypes), dict(ps.dtypes)
    mixed = [k for k in keys if "string" in (ours[k], theirs[k]) and ours[k] != theirs[k]]
    if mixed:
        df, ps = ids_to_string(df, mixed), ids_to_string(ps, mixed)
    if not null_safe:
        ps = ps.dropna(subset=keys)
    ps = _one_row_for_each_key(ps, keys)
    if not null_safe:
        return df.join(ps, keys)
    renamed = ps.withColumnsRenamed({k: f"_ps_{k}" for k in keys})
    other = [f"_ps_{k}" for k in keys]
    return df.join(renamed, same(df, renamed, keys, other)).drop(*other)



def _one_row_for_each_key(ps: DataFrame, keys: list[str]) -> DataFrame:
    """``ps``, of which reading a key that occurs twice raises."""
    other = [c for c in ps.columns if c not in keys]
    message = f"post-strata have more than one row for the same {', '.join(keys)}"
    grouped = ps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in other))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit(message))).otherwise(F.lit(True))
    return grouped.filter(once).select(*ps.columns)
