"""Folders that a job uses for itself, where all executors see them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or f'file://{LOCAL_FOLDER}').rstrip('/')}/{name}-{uuid.uuid4().hex}"
