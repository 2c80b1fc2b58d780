"""Materialised intermediates in the folder that the cluster shares.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs at most the tasks of the stage that was running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, name: str, spent: Sequence[str] = (), **options: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written; the tables at ``spent`` served ``df`` alone and are deleted."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    for old in spent:
        discard(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Delete what this session materialised; DataFrames that still read it become invalid."""
    try:
        for path in list(_WRITTEN):
            discard(spark, path)
    except Exception:  # the session is already gone: its folder outlives it
        _WRITTEN.clear()
