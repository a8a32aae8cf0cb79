"""A folder for files that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which all executors share. Where that is unset, under a temporary folder on a local
    master; an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docaudit-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
