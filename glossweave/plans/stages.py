"""Cutting lineage between the rounds of iterative operators, and broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows that are broadcast at most.
FEW = 100_000


def bounded(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, marked for a broadcast if it has few rows; its size is looked at first, and the optimizer chooses for a larger one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's shared checkpoint folder; local sessions that name none have one of their own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint()
