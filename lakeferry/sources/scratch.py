"""Working folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a local one where that isn't set."""
    return f"{shared_root(spark).rstrip('/')}/lakeferry-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root or tempfile.gettempdir()
