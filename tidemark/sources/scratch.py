"""Lineage cuts in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_paths: dict[str, SparkSession] = {}


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names. A session in one process (tests) may do without; a cluster may not."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _own_folder()
    raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive lost executors. They go when ``forget`` is told so, else when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """``settle``, with the number of rows, which is counted as they are written."""
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def forget(*frames: DataFrame) -> None:
    """Delete the files of settled ``frames``, which nothing may read any more."""
    for df in frames:
        _delete(getattr(df, "_settled", None))


def _delete(path: str | None) -> None:
    spark = _paths.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before us; its folder is the cluster's to clean
        pass


@atexit.register
def _forget_all() -> None:
    for path in list(_paths):
        _delete(path)
