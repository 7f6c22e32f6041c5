"""The folder for tables and stages that the session does not name a place for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset a local session gets a temporary folder; on a
    cluster each executor would write to its own disk, so there it is an error."""
    root = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.conf.set(CHECKPOINT, root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
