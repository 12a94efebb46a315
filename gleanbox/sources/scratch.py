"""A folder for what a job writes on its way, shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gleanbox-")
    return f"{base.rstrip('/')}/outbox-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
