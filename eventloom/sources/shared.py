"""A folder for files that one job writes and another reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def unused_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names the folder in spark.checkpoint.dir. Only a local session without
    that setting gets one of its own, since on a cluster it would be another one on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{named.rstrip('/')}/eventloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
