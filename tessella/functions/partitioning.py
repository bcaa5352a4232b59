"""Spreading work over the cores where a table has fewer splits than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The same rows, over all cores where what they are scanned from has fewer splits than that; for costly work on small tables.

    Larger tables, and those whose size isn't known, stay as they are: nothing is shuffled. Only the plan is looked at."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    splits = -(-size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if splits >= cores else df.repartition(cores)
