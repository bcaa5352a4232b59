"""Cutting lineage so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset (a local session, as in tests) one of this machine.

    On a cluster the setting has to name a folder that all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, written with further options."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def collect_garbage(spark: SparkSession, executors: bool = True) -> None:
    """Collects garbage in the driver and, unless told otherwise, in the executors, whose heaps give back what they don't need.

    An executor's heap grows up to its limit with the arrays that pass through it, and shrinks only in a full collection;
    its Python workers need that memory. As many tasks as cores, so that most executors get one; it is no matter if one doesn't."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
    if not executors:
        return
    tasks = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') is null as done").write.format("noop").mode("overwrite").save()
