"""Fixed-width text as a projection over Spark's text source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.first_row import RowOrder
from ..operators.numbering import row_in_task, starts
from ..workspace import hint_if, local_if_small
from .layouts import Field

# The order of lines in the files (see ``read_fwf``).
FILE_ORDER = RowOrder(("src_line",), {"src_line": 18}, unique=True)


class FieldProblems:
    """Blank and unreadable fields, counted by the pass that reads the lines.

    Pass it to ``read_fwf``; after the first action on what that returns, ``table`` has the
    counts.  A task that runs again after an executor is lost may count twice.
    """

    def __init__(self):
        self._seen, self._names = Observation(), []

    def attach(self, lines: DataFrame, layout: list[Field], texts: dict[str, Column]) -> DataFrame:
        """Count on ``lines``, which hold the parsed fields and the columns of ``texts``."""
        self._names = [f.name for f in layout]
        counts = []
        for i, f in enumerate(layout):
            text = texts[f.name]
            counts.append(F.count_if(text.isNull()).alias(f"m{i}"))
            counts.append(F.count_if(text.isNotNull() & F.col(f.name).isNull()).alias(f"u{i}"))
        return lines.observe(self._seen, *counts)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(field, n_missing, n_unreadable)``; waits for the first action."""
        seen = self._seen.get
        rows = [(name, seen.get(f"m{i}", 0), seen.get(f"u{i}", 0)) for i, name in enumerate(self._names)]
        return spark.createDataFrame(rows, "field string, n_missing long, n_unreadable long")


def read_fwf(
    spark: SparkSession,
    path,
    layout: list[Field],
    na_strings: tuple[str, ...] = (),
    file_order: bool = False,
    problems: FieldProblems | None = None,
) -> DataFrame:
    """Cut each line by ``layout``; blank, short, marked or unreadable fields become NULL.

    ``file_order`` adds ``src_line``: 1, 2, 3 ... along the lines of all files, files in order
    of their paths.  It counts the lines of each split when called.  ``problems`` tells blank
    fields from unreadable ones, without a pass of its own.
    """
    lines = _numbered_lines(spark, path) if file_order else spark.read.text(path)
    number = ["src_line"] if file_order else []
    if problems is None:
        return lines.select(*(_field(F.col("value"), f, na_strings) for f in layout), *number)
    # Each text is cut once, for its field and for both counts.
    texts = [f"_text{i}" for i in range(len(layout))]
    cut = _texts(lines, layout, na_strings, texts, number)
    parsed = cut.select(*texts, *(_number(F.col(t), f).alias(f.name) for t, f in zip(texts, layout)), *number)
    return problems.attach(parsed, layout, {f.name: F.col(t) for t, f in zip(texts, layout)}).drop(*texts)


def _numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``value, src_line``: a line's place in its split, and the lines of all splits before that one.

    A split is a file and the byte at which a task's share of it begins.  The counts are one
    row for each split; no task reads more than its splits.
    """
    marked = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        row_in_task().alias("row"),
        F.spark_partition_id().alias("task"),
    )
    splits = marked.groupBy("src_file", "src_block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("row").alias("first"), F.min("task").alias("in_task")
    )
    numbered = starts(splits, ["src_file", "src_block"], "lines", "before").drop("lines")
    table, small = local_if_small(numbered)
    joined = marked.join(hint_if(table, small), ["src_file", "src_block"], "left")
    # Splits are planned alike as long as files and settings stay; if not, nothing is numbered wrongly.
    same = F.coalesce(F.col("task") == F.col("in_task"), F.lit(False))
    line = F.when(same, F.col("before") + F.col("row") - F.col("first") + 1)
    changed = F.raise_error(F.lit("files or split settings have changed since their lines were counted"))
    return joined.select("value", line.when(~same, changed).alias("src_line"))


def field_problems(
    spark: SparkSession, path, layout: list[Field], na_strings: tuple[str, ...] = ()
) -> DataFrame:
    """``(field, n_missing, n_unreadable)``: blank or marked fields, and text that is no number.

    ``read_fwf`` makes both NULL; this pass over the lines tells them apart.  ``FieldProblems``
    counts the same while the lines are read.
    """
    texts = [f"_text{i}" for i in range(len(layout))]
    lines = _texts(spark.read.text(path), layout, na_strings, texts)
    counts = []
    for text, f in zip(map(F.col, texts), layout):
        counts.append(F.count_if(text.isNull()).alias(f"m_{f.name}"))
        counts.append(F.count_if(text.isNotNull() & _number(text, f).isNull()).alias(f"u_{f.name}"))
    rows = [
        F.struct(F.lit(f.name).alias("field"), F.col(f"m_{f.name}").alias("n_missing"), F.col(f"u_{f.name}").alias("n_unreadable"))
        for f in layout
    ]
    return lines.agg(*counts).select(F.inline(F.array(*rows)))


def _texts(lines: DataFrame, layout: list[Field], na_strings: tuple[str, ...], names: list[str], other: Sequence[str] = ()) -> DataFrame:
    """All fields' texts, cut from pieces of the line: a cut counts characters from where it looks."""
    widest: dict[int, int] = {}
    for f in layout:
        piece = (f.start - 1) // _PIECE
        widest[piece] = max(widest.get(piece, 0), f.width)
    pieces = [F.substring("value", k * _PIECE + 1, _PIECE + w).alias(f"_piece{k}") for k, w in widest.items()]
    columns = []
    for f, name in zip(layout, names):
        piece, start = divmod(f.start - 1, _PIECE)
        columns.append(_text(F.col(f"_piece{piece}"), Field(f.name, start + 1, f.width, f.dtype), na_strings).alias(name))
    return lines.select(*pieces, *other).select(*columns, *other)


_PIECE = 24


def _field(line: Column, field: Field, na_strings: tuple[str, ...]) -> Column:
    return _number(_text(line, field, na_strings), field).alias(field.name)


# Characters that no whole number has, nor the blanks around one.
_NOT_WHOLE = "[!-*,./:-~]"


def _number(text: Column, field: Field) -> Column:
    """``text`` as the field's type, NULL if it is unreadable.

    Spark raises and catches an error for each text that it cannot cast, which takes far longer
    than the cast; text that plainly is no whole number never gets there.
    """
    dtype = T.DataType.fromDDL(field.dtype) if isinstance(field.dtype, str) else field.dtype
    if not isinstance(dtype, T.IntegralType):
        return text.try_cast(dtype)
    return F.when(~text.rlike(_NOT_WHOLE), text.try_cast(dtype))


def _text(line: Column, field: Field, na_strings: tuple[str, ...]) -> Column:
    raw = F.substring(line, field.start, field.width)
    text = F.nullif(F.trim(raw), F.lit(""))
    for marker in na_strings:
        if marker.strip():
            text = F.nullif(text, F.lit(marker.strip()))
    return text
