"""Hourly counts as a stream, and detection for each batch of closed hours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import cents


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events, total and approximate distinct users and sessions for each hour and type; hours close when events are later than late."""
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    sums = timed.groupBy(F.window("event_time", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("event_count"), F.approx_count_distinct("user_id").alias("unique_users"), F.approx_count_distinct("session_id").alias("unique_sessions"), (F.sum(cents()) / F.lit(100.0)).alias("total_amount"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("hour_ts"), "event_type", "event_count", "unique_users", "unique_sessions", "total_amount")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, whatever is sent again within the lateness."""
    return events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["event_id"])


def each_batch(counts: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that gives closed hours to handle, each once for a batch number."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
