"""Report sinks: one dataset per workbook, one partition per sheet; and decimal-comma CSV."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


_CURRENT = "_current"


def write_report(sheets: dict[str, DataFrame] | DataFrame, path: str) -> None:
    """Publish every sheet at ``path`` as a whole; ``read_sheet`` gets them back.

    ``sheets`` is a table per name, or one table with a ``sheet`` column.  The data are
    written beside the previous report, into a folder of their own; then one small file that
    names that folder takes the place of its predecessor.  Until then, and if the job dies,
    readers get the previous report.  The report before that one is deleted afterwards, so a
    reader that began just before the change can end.
    """
    if isinstance(sheets, dict):
        tagged = [df.withColumn("sheet", F.lit(name)) for name, df in sheets.items()]
        sheets = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    spark = sheets.sparkSession
    previous = _published(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    sheets.write.partitionBy("sheet").parquet(f"{path}/{version}")
    _publish(spark, path, version)
    _delete_others(spark, path, {version, previous})


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of the published report, with their names in ``sheet``."""
    version = _published(spark, path)
    if version is None:
        raise FileNotFoundError(f"no report was published at {path}")
    return spark.read.parquet(f"{path}/{version}")


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    return read_report(spark, path).filter(F.col("sheet") == sheet).drop("sheet")


def _hadoop(spark: SparkSession, path: str):
    """The file system of ``path`` and the path itself."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(conf), folder


def _published(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the published report."""
    fs, current = _hadoop(spark, f"{path}/{_CURRENT}")
    if not fs.exists(current):
        return None
    stream = fs.open(current)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Replace the file that names the published folder, by a rename that overwrites."""
    jvm = spark.sparkContext._jvm
    fs, beside = _hadoop(spark, f"{path}/{_CURRENT}-{version}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, jvm.org.apache.hadoop.fs.Path(f"{path}/{_CURRENT}"), options)


def _delete_others(spark: SparkSession, path: str, keep: set) -> None:
    """Delete reports before the previous one, and those that were never published."""
    fs, folder = _hadoop(spark, path)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in keep:
            fs.delete(status.getPath(), True)


def write_csv2(df: DataFrame, path: str) -> None:
    """CSV with ``;`` between fields and ``,`` as the decimal mark; NULL is written NA."""
    columns = []
    for f in df.schema.fields:
        text = F.col(f.name).cast("string")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            text = F.replace(text, F.lit("."), F.lit(","))
        columns.append(text.alias(f.name))
    df.select(*columns).write.mode("overwrite").csv(
        path, sep=";", header=True, nullValue="NA", emptyValue=""
    )


def read_csv2(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back what ``write_csv2`` wrote."""
    raw = spark.read.csv(path, sep=";", header=True, nullValue="NA")
    columns = []
    for f in schema.fields:
        text = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            text = F.replace(text, F.lit(","), F.lit("."))
        columns.append(text.cast(f.dataType).alias(f.name))
    return raw.select(*columns)
