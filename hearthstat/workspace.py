"""Shared-folder staging and size-checked local tables.

A household base is read several times by one report (cut points, medians,
estimates).  Staging writes it once as Parquet in the folder the cluster shares,
so later passes are column-pruned scans that survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a small dimension or result may have and still be handled as a local table.
LOCAL_ROWS = 50_000


class Workspace:
    """A private sub-folder of the cluster's checkpoint folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{root or shared_folder(spark)}/hearthstat-{uuid.uuid4().hex}"

    def child(self, name: str) -> str:
        return f"{self.path}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of the written table."""
        path = self.child(f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the folder; DataFrames staged here must no longer be used."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder.getFileSystem(conf).delete(folder, True)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *exc) -> None:
        self.close()


_session_spaces: dict[str, Workspace] = {}


def session_space(spark: SparkSession) -> Workspace:
    """A workspace for what outlives the call that made it; deleted when the process ends."""
    application = spark.sparkContext.applicationId
    if application not in _session_spaces:
        _session_spaces[application] = Workspace(spark)
        atexit.register(close_session_space, spark)
    return _session_spaces[application]


def close_session_space(spark: SparkSession) -> None:
    """Delete the session's workspace now; tables in it must no longer be used."""
    if spark.sparkContext._jsc is None:
        return
    space = _session_spaces.pop(spark.sparkContext.applicationId, None)
    if space is not None:
        space.close()


def configure(spark: SparkSession) -> SparkSession:
    """Adaptive settings the joins rely on when one key holds much of the data.

    A join that feeds a grouping by the same key is split too, at the price of one more
    shuffle of rows that are already merged.
    """
    for name in (
        "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.skewJoin.enabled",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
    ):
        spark.conf.set(name, "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hearthstat-"))
    return context.getCheckpointDir().rstrip("/")


def local_if_small(
    df: DataFrame, max_rows: int = LOCAL_ROWS, proven: bool = False
) -> tuple[DataFrame, bool]:
    """Evaluate ``df`` and return it as a local table if it has at most ``max_rows`` rows.

    Larger tables are returned unevaluated, so the caller joins them by shuffle.
    ``proven`` skips the check where the caller knows the bound.
    """
    local, rows = local_rows(df, max_rows, proven)
    return local, rows is not None


def local_rows(
    df: DataFrame, max_rows: int = LOCAL_ROWS, proven: bool = False
) -> tuple[DataFrame, pa.Table | None]:
    """As ``local_if_small``, with the rows themselves or None."""
    rows = (df if proven else df.limit(max_rows + 1)).toArrow()
    if rows.num_rows > max_rows:
        return df, None
    return df.sparkSession.createDataFrame(rows, df.schema), rows


def hint_if(df: DataFrame, small: bool) -> DataFrame:
    """Ask for a broadcast only when the size has been checked."""
    return F.broadcast(df) if small else df


def same(left: DataFrame, right: DataFrame, keys, right_keys=None):
    """Join condition that also matches NULL with NULL."""
    cond = F.lit(True)
    for i, (a, b) in enumerate(zip(keys, right_keys or keys)):
        term = left[a].eqNullSafe(right[b])
        cond = term if i == 0 else cond & term
    return cond
