"""Health of the monitor: runs, freshness of events, the incident queue, and the status of all."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .baselines import at
from .lifecycle import MINUTE, age

ORDER = ("unhealthy", "critical", "warning", "healthy")


def recent_runs(runs: DataFrame, as_of: datetime, max_gap_minutes: float = 30) -> DataFrame:
    """One row: the last completed run, how long ago, failures of the last hour, status."""
    done = F.col("status") == "completed"
    one = runs.agg(F.max(F.when(done, F.col("ended_at"))).alias("last_ended_at"), F.max_by("run_id", F.when(done, F.col("ended_at"))).alias("run_id"), F.count_if((F.col("status") == "failed") & (F.col("started_at") >= at(as_of - timedelta(hours=1)))).alias("failed_count"))
    minutes = F.round(age(F.col("last_ended_at"), as_of, MINUTE), 4)
    return one.select("run_id", "last_ended_at", minutes.alias("minutes_ago"), "failed_count", F.when(F.col("last_ended_at").isNull(), "warning").when(minutes > max_gap_minutes, "unhealthy").otherwise("healthy").alias("status"))


def freshness(events: DataFrame, as_of: datetime, warn_minutes: float = 30) -> DataFrame:
    """One row: the latest event of the last hour, how many there were, status."""
    recent = events.where((F.col("event_time") >= at(as_of - timedelta(hours=1))) & (F.col("event_time") <= at(as_of)))
    one = recent.agg(F.max("event_time").alias("latest_event"), F.count(F.lit(1)).alias("events_last_hour"))
    minutes = F.round(age(F.col("latest_event"), as_of, MINUTE), 4)
    return one.select("latest_event", minutes.alias("minutes_ago"), "events_last_hour", F.when(F.col("latest_event").isNull() | (minutes > warn_minutes), "warning").otherwise("healthy").alias("status"))


def incident_queue(incidents: DataFrame) -> DataFrame:
    open_ = incidents.where(F.col("resolved_at").isNull())
    one = open_.agg(F.count_if(F.col("severity") == "critical").alias("critical_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"), F.count_if(F.col("alert_sent_at").isNull()).alias("pending_alerts"), F.count(F.lit(1)).alias("total_active"))
    return one.withColumn("status", F.when(F.col("critical_count") > 0, "critical").when(F.col("warning_count") > 0, "warning").otherwise("healthy"))


def run_statistics(runs: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    recent = runs.where(F.col("started_at") >= at(as_of - timedelta(hours=hours)))
    seconds = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1e6)
    one = recent.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 4).alias("avg_duration_seconds"), F.coalesce(F.sum("anomalies_detected"), F.lit(0)).cast("bigint").alias("total_anomalies"))
    return one.withColumn("success_rate", F.when(F.col("total_runs") > 0, F.round(F.col("completed") * F.lit(100.0) / F.col("total_runs"), 4)).otherwise(F.lit(0.0)))


def connection(spark: SparkSession) -> dict:
    """Whether the session answers at all."""
    try:
        return {"status": "healthy" if spark.sql("SELECT 1").first()[0] == 1 else "unhealthy"}
    except Exception as e:  # whatever keeps it from answering is what the check reports
        return {"status": "unhealthy", "message": str(e)[:500]}


def overall(statuses: list[str]) -> str:
    """The worst of statuses."""
    return min(statuses, key=ORDER.index, default="healthy")


def report(events: DataFrame, runs: DataFrame, incidents: DataFrame, as_of: datetime, max_gap_minutes: float = 30) -> dict:
    """All checks as one document; each is one row."""
    checks = {"recent_runs": recent_runs(runs, as_of, max_gap_minutes), "data_freshness": freshness(events, as_of), "incidents": incident_queue(incidents)}
    found = {"connection": connection(events.sparkSession)} | {k: v.first().asDict() for k, v in checks.items()}
    return {"timestamp": as_of.isoformat(), "overall_status": overall([c["status"] for c in found.values()]), "checks": found, "statistics": run_statistics(runs, as_of).first().asDict()}
