"""Fixed-width text written by Spark, as input for the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from hearthstat.sources.layouts import Field


def write_fwf(df: DataFrame, path: str, layout: list[Field], decimals: int = 2) -> None:
    """Write one line per row: right-aligned fields, NULL and absent columns blank.

    A value too wide for its field is an error, never cut.
    """
    present = set(df.columns)
    written = [f for f in layout if f.name in present]
    # Texts come first, so that each value is made into text once.
    values = {f.name: F.col(f.name).cast(T.DecimalType(30, decimals)) if isinstance(f.dtype, T.DoubleType) else F.col(f.name) for f in written}
    texts = df.select(*(values[f.name].cast("string").alias(f.name) for f in written))
    parts = []
    for f in layout:
        blank = F.lit(" " * f.width)
        if f.name not in present:
            parts.append(blank)
            continue
        text = F.col(f.name)
        fitted = F.when(F.length(text) <= f.width, F.lpad(text, f.width, " ")).otherwise(
            F.raise_error(F.concat(F.lit(f"value too wide for {f.name}: "), text))
        )
        parts.append(F.when(text.isNull(), blank).otherwise(fitted))
    texts.select(F.concat(*parts).alias("value")).write.mode("overwrite").text(path)
