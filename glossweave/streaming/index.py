"""The search index kept up to date from a stream of changed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_index(changes: DataFrame, path: str, checkpoint: str):
    """Starts a query that replaces, batch by batch, the index rows of each source that a batch has rows of.

    The index is Parquet partitioned by source_key; a batch that is run again writes the same partitions again.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) counted and summed by windows of time; later ones than `late` are left out on a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")
