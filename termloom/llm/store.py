"""Intermediate tables in the folder the cluster shares, and size-checked joins.

A table written here is the recovery point of a multi-pass operator: a lost
executor costs the tasks it ran since the last such table, never the lineage
before it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key-only side up to which it may be broadcast (16 MB of longs).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/termloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if "/termloom-" in f:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def without(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is not in ``keys``.

    ``keys`` is broadcast after its size was checked; beyond BROADCAST_ROWS
    the join shuffles, and AQE splits what is skewed.
    """
    if small(keys):
        keys = F.broadcast(keys)
    else:
        keys = keys.hint("merge")
    return docs.join(keys, on, "left_anti")
