"""Use all cores when an input is too small to be split by its files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def planned_bytes(df: DataFrame) -> int:
    """Size of a plan as the optimizer estimates it (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fill_cores(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a small table before heavy row-local work.

    A table below one scan split per core may sit in a single row group and so
    in a single task.  A large table already has more splits than cores and is
    left as it is: nothing is shuffled there.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if planned_bytes(df) >= cores * split:
        return df
    return df.repartition(cores, key)
