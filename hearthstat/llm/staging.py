"""Tables written once to the shared folder, kept until the session's Python ends."""

from __future__ import annotations

import atexit
import gc

from pyspark.sql import DataFrame, SparkSession

from hearthstat.workspace import Workspace

_spaces: dict[str, Workspace] = {}


# What Python workers are started with: large blocks go back to the system when they are freed.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(2 << 20),
}


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python in batches of a few MB, so that a worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    return spark


def workspace(spark: SparkSession) -> Workspace:
    """This session's sub-folder of ``spark.checkpoint.dir``, deleted at the end of the process."""
    application = spark.sparkContext.applicationId
    if application not in _spaces:
        _spaces[application] = Workspace(spark)
        atexit.register(_close, application)
    return _spaces[application]


def _close(application: str) -> None:
    space = _spaces.pop(application, None)
    if space is not None and space.spark.sparkContext._jsc is not None:
        space.close()


def staged(df: DataFrame, name: str, collect: bool = True) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    Shuffle files of steps that are over go first: Spark drops them when the driver collects
    the garbage that refers to them, and a driver with little to do may not do so for long.
    Without ``collect`` they stay until the next table: for small steps in close succession.
    """
    if collect:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return workspace(df.sparkSession).stage(df, name)


def forget(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = workspace(spark).path.rstrip("/").rsplit("/", 1)[-1]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if f"/{root}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
