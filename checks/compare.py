"""Run registered queries against their SQL twins in DuckDB.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from hearthstat.workspace import configure

from .oracles import oracle_sql
from .queries import QUERIES


def session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if not isinstance(v, (str, bool)) else v


def _sorted_rows(rows, order):
    picked = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda t: tuple((v is None, str(type(v)), v) for v in t))


def difference(spark_df, cursor) -> str | None:
    """None when both results hold the same rows, otherwise what differs first."""
    ours, theirs = spark_df.columns, [d[0] for d in cursor.description]
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    names = sorted(ours)
    a = _sorted_rows(spark_df.collect(), [ours.index(n) for n in names])
    b = _sorted_rows(cursor.fetchall(), [theirs.index(n) for n in names])
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    if not a:
        return "no rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{names}: {x} != {y}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, sql, bad = session(), database(sf_dir), oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            found = difference(QUERIES[name](spark, sf_dir), con.execute(sql[name]))
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
