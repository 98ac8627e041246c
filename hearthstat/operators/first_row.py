"""The first row of a group in a given order, found by hash aggregation.

Spark compares rows of several order columns only after a sort, because such a value has no
fixed width.  Here the order columns become one number of fixed width that grows as they do:
each column is a digit, NULL its 0, in a base that holds all its values.  The base comes from
the number of decimal digits a column is declared to have, else from its type.  Rows equal in
all order columns are told apart by a last digit, a hash of the values kept, so that every
kept value comes from the same row in every run.  One to three such digits fill a long, more
a decimal; both are compared inside the hash map of the aggregation, before and after the
shuffle.

Orders that no 38 digits can hold, or of types without a whole number (text, doubles), compare
structs, with the same rule for NULLs and ties, and make Spark sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

LONGEST = 10**38  # numbers a decimal can tell apart
LONG = 2**63
TIES = 10**15  # numbers for the hash of the kept values


@dataclass(frozen=True)
class RowOrder:
    """Order columns, how many decimal digits their whole numbers have, and whether no two rows tie.

    A declared column holds 0 to 10**digits - 1 or NULL; any other value is an error when the
    rows are read, never a wrong order.
    """

    columns: Sequence[str]
    digits: Mapping[str, int] = field(default_factory=dict)
    unique: bool = False

    @classmethod
    def of(cls, order: "RowOrder | Sequence[str]") -> "RowOrder":
        return order if isinstance(order, RowOrder) else cls(tuple(order))


def first_row(items: DataFrame, keep: Sequence[str], order: RowOrder | Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Aggregates for a group's first row in ``order``, NULLs first, and how to name what they keep."""
    order, keep = RowOrder.of(order), list(keep)
    key = order_key(items, keep, order)
    if key is not None:
        return [F.min_by(c, key).alias(f"_first_{c}") for c in keep], [F.col(f"_first_{c}").alias(c) for c in keep]
    sort = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order.columns)]
    first = F.min(F.struct(*sort, _tie(keep).alias("_tie"), *keep)).alias("_first")
    return [first], [F.col(f"_first.{c}").alias(c) for c in keep]


def order_key(items: DataFrame, keep: Sequence[str], order: RowOrder) -> Column | None:
    """One number that grows along ``order``, or None if there is none of fixed width."""
    parts = []
    for c in order.columns:
        part = _digit(c, items.schema[c].dataType, order.digits.get(c))
        if part is None:
            return None
        parts.append(part)
    if not order.unique and keep:
        parts.append((_tie(keep), TIES))
    total = 1
    for _, base in parts:
        total *= base
    return _packed(parts) if parts and total < LONGEST else None


def _tie(keep: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keep), F.lit(TIES)) if keep else F.lit(0).cast("long")


def _digit(name: str, dtype: T.DataType, digits: int | None) -> tuple[Column, int] | None:
    """The column as a whole number from 1, or 0 for NULL, and a base above it."""
    c = F.col(name)
    if digits is not None and isinstance(dtype, T.IntegralType):
        wrong = F.raise_error(F.concat(F.lit(f"{name} has more than {digits} digits: "), c.cast("string")))
        return F.when(c.isNull(), F.lit(0).cast("long")).when((c >= 0) & (c < 10**digits), c.cast("long") + 1).otherwise(wrong), 10**digits + 1
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("long") + 1, F.lit(0)), 3
    if isinstance(dtype, T.DateType):
        c, dtype = F.unix_date(c), T.IntegerType()
    elif isinstance(dtype, T.TimestampType):
        c, dtype = F.unix_micros(c), T.LongType()
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(dtype))
    if bits is None:
        return None
    wide = "long" if bits < 64 else "decimal(20,0)"
    lowest = F.lit(str(2 ** (bits - 1) + 1)).cast(wide)
    return F.coalesce(c.cast(wide) + lowest, F.lit(0).cast(wide)), 2**bits + 1


def _packed(parts: list[tuple[Column, int]]) -> Column:
    """All digits as one number: longs as far as they go, then decimals."""
    runs: list[tuple[Column, int]] = []
    for column, base in parts:
        if runs and runs[-1][1] * base < LONG:
            column, base = runs[-1][0] * F.lit(base) + column, runs.pop()[1] * base
        runs.append((column, base))
    key = runs[0][0]
    if len(runs) > 1 or runs[0][1] >= LONG:
        key = key.cast("decimal(38,0)")
    for column, base in runs[1:]:
        factor = F.lit(str(base)).cast(f"decimal({len(str(base))},0)")
        key = ((key * factor).cast("decimal(38,0)") + column.cast("decimal(38,0)")).cast("decimal(38,0)")
    return key
