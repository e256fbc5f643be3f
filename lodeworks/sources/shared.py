"""The folder that driver and executors share, for checkpoints and results of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without it gets a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/streams/{label}-{uuid.uuid4().hex}"


def remove_settled(spark: SparkSession) -> None:
    """Deletes all tables that iterations have left in the shared folder; results not evaluated yet become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/streams")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
