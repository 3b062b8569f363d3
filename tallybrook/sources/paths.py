"""Folders for what a query writes on its way."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, as the session names it; only a session that runs in
    one process may leave it unnamed."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file:///tmp/checkpoints"
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
