"""Cutting lineage and deciding on broadcasts, both safe on a cluster.

Executors may be lost at any time, so intermediate results that are read more
than once go to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names of what goes to the shared folder.
PREFIXES = ("cut-", "rollup-", "pipeline-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only where none is set (tests) an own one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):  # another host doesn't see this one's folders
            raise ValueError(f"spark.checkpoint.dir must name a folder that all hosts of {master} share")
        where = tempfile.mkdtemp(prefix="geoweft-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def sweep(spark: SparkSession, older_than: float = 86_400.0) -> list[str]:
    """Delete what this library wrote to the shared folder more than so many seconds ago.

    Results are lazy, so nothing can be deleted when a query returns; call this between jobs,
    with an age that no running query has.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(where):
        path = status.getPath()
        if path.getName().startswith(PREFIXES) and status.getModificationTime() / 1000 <= time.time() - older_than and fs.delete(path, True):
            gone.append(path.getName())
    return gone


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with a short plan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the counted size is below the limit; else leave a shuffle join."""
    n = df.limit(limit_bytes // row_bytes + 1).count()
    return F.broadcast(df) if n * row_bytes <= limit_bytes else df
