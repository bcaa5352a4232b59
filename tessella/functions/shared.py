"""The folder that all executors share, where tables and files of one run lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path in `spark.checkpoint.dir`; where that is unset (a local session, as in tests) in a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"
