"""Intermediate tables in the folder that the cluster shares: lineage is cut, and layouts stay as they were dealt."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on a local master without one, a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table, and a scan of it that reads only the columns asked for."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
