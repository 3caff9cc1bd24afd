"""Shared working folder for checkpoints and streaming output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder named by the session. Only a local session without the setting gets a temporary one."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="opslens-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder no other run uses."""
    return f"{shared_root(spark)}/opslens/{name}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a working folder that nothing reads any more."""
    if "/opslens/" not in path:
        raise ValueError(f"{path} is not a working folder")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
