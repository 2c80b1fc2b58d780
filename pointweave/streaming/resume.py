"""Resuming a stream only with the settings it was begun with."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import SparkSession


def config_digest(config: Mapping) -> str:
    """A hash of settings, whatever their order; values must be plain JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def resume_folder(spark: SparkSession, root: str, config: Mapping) -> str:
    """The checkpoint folder of a stream under ``root``, once its settings agree with those it was begun with.

    The first call files the digest beside the folder; later ones with other
    settings are refused, so no state is read under another meaning.
    """
    context, digest = spark.sparkContext, config_digest(config)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{root}/config")
    if path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.text(f"{root}/config").first()["value"]
        if held != digest:
            raise ValueError("the stream was begun with other settings")
    else:
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(f"{root}/config")
    return f"{root}/checkpoint"
