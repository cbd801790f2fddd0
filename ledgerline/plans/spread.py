"""More tasks for a small scan whose rows are costly."""

from __future__ import annotations

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's plan takes the table's size to be: what there is of a table's memory before it is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def widened(df: DataFrame) -> DataFrame:
    """Deal the rows out when the plan's estimated size gives less than half a task per core; the result is the same.

    A large table is left as it is scanned; only one too small to fill the cores is
    shuffled, before an expression that costs far more than moving its rows.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    piece = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size <= piece * cores / 2 else df
