"""Where a job may write intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only for local sessions."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="cohortlens-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that no other call returns."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
