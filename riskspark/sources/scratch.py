"""A folder for intermediate files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where none is set a local folder serves a local master alone; on a cluster
    each executor would write to its own disk, so there it raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskspark-")
    return f"{found.rstrip('/')}/riskspark/{name}-{uuid.uuid4().hex}"
