"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local one serves a session that runs in one process; on a cluster its executors could not see it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once all that was made from them is written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    collect_garbage()


def collect_garbage() -> None:
    """Shuffle files go when the driver's JVM finds that nothing refers to them any more; this asks it to look."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint when ``rows * row_bytes`` is at most ``limit`` bytes; beyond it the join stays a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def slices(values, weights, most: int):
    """Runs (start, stop) of ``values`` whose weights sum to about ``most``: bounds the memory of a batch step."""
    start, total = 0, 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(values):
        yield start, len(values)
