"""The folder that the driver and every executor share, for tables between jobs and checkpoints of streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master (tests) gets a temporary folder, set once, and a cluster an error."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{KEY} has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
