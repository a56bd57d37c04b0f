"""What happens to incidents and old rows: listing, suppression, grouping, resolution, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import AlertConfig, RetentionConfig
from ..schema import rank
from .baselines import at

MINUTE = 60_000_000


def age(t: Column, as_of: datetime, unit: float) -> Column:
    """Microseconds since t, over unit."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(at(as_of)) - micros(t)) / F.lit(float(unit))


def active_incidents(incidents: DataFrame, as_of: datetime) -> DataFrame:
    """Unresolved and not suppressed, worst and latest first."""
    rows = incidents.where(F.col("resolved_at").isNull() & (F.col("is_suppressed") == F.lit(False)))
    aged = rows.withColumns({"hours_active": F.round(age(F.col("first_detected_at"), as_of, 60 * MINUTE), 6), "minutes_since_last": F.round(age(F.col("last_detected_at"), as_of, MINUTE), 6)})
    return aged.orderBy(rank(F.col("severity")), F.col("last_detected_at").desc_nulls_last(), "incident_key")


def incident_summary(incidents: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    recent = incidents.where(F.col("last_detected_at") >= at(as_of - timedelta(hours=hours)))
    return recent.groupBy("severity").agg(F.count(F.lit(1)).alias("incident_count"), F.count_if(F.col("alert_sent_at").isNull()).alias("pending_alerts"), F.count_if(F.col("resolved_at").isNotNull()).alias("resolved_count"), F.min("first_detected_at").alias("earliest_detection"), F.max("last_detected_at").alias("latest_detection"))


def resolve_stale(incidents: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Incidents not seen for so many hours get resolved."""
    stale = F.col("resolved_at").isNull() & (F.col("last_detected_at") < at(as_of - timedelta(hours=hours)))
    note = F.lit(f"Resolved by itself: not seen for {hours:g} hours")
    return incidents.withColumns({"resolved_at": F.when(stale, at(as_of)).otherwise(F.col("resolved_at")), "resolution_notes": F.when(stale, note).otherwise(F.col("resolution_notes"))})


def cleanup_anomalies(anomalies: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """What a clean-up by age keeps."""
    return anomalies.where(F.coalesce(F.col("detected_at") >= at(as_of - timedelta(days=days)), F.lit(True)))


def apply_retention(anomalies: DataFrame, runs: DataFrame, baselines: DataFrame, as_of: datetime, cfg: RetentionConfig = RetentionConfig()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(anomalies, runs, baselines) that stay, and one row of how many go. Incidents are never pruned."""
    old_run = F.coalesce(F.col("started_at") < at(as_of - timedelta(days=cfg.runs_days)), F.lit(False))
    old_rows = F.coalesce(F.col("detected_at") < at(as_of - timedelta(days=cfg.anomalies_days)), F.lit(False))
    old_base = F.coalesce(F.col("period_end") < at(as_of - timedelta(days=cfg.baselines_days)), F.lit(False))
    expired = runs.where(old_run).select("run_id").distinct()
    kept = anomalies.join(expired, "run_id", "left_anti").where(~old_rows)
    marked = anomalies.join(expired.withColumn("_gone", F.lit(True)), "run_id", "left")
    a = marked.agg(F.count_if(F.coalesce(F.col("_gone"), F.lit(False)) | old_rows).alias("deleted_anomalies"))
    b, r = baselines.agg(F.count_if(old_base).alias("deleted_baselines")), runs.agg(F.count_if(old_run).alias("deleted_runs"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    counts = one(a).join(one(b), "_k").join(one(r), "_k").drop("_k")
    return kept, runs.where(~old_run), baselines.where(~old_base), counts


def observed_retention(anomalies: DataFrame, runs: DataFrame, baselines: DataFrame, as_of: datetime, cfg: RetentionConfig = RetentionConfig()) -> tuple[dict[str, DataFrame], dict]:
    """({table: what stays}, {name: how many went, once what stays has been written}): rows are counted on their way, so no table is read twice."""
    old_run = F.coalesce(F.col("started_at") < at(as_of - timedelta(days=cfg.runs_days)), F.lit(False))
    old_rows = F.coalesce(F.col("detected_at") < at(as_of - timedelta(days=cfg.anomalies_days)), F.lit(False))
    old_base = F.coalesce(F.col("period_end") < at(as_of - timedelta(days=cfg.baselines_days)), F.lit(False))
    expired = runs.where(old_run).select("run_id", F.lit(True).alias("_expired")).distinct()
    marked = {
        "anomalies": anomalies.join(expired, "run_id", "left").withColumn("_gone", old_rows | F.coalesce(F.col("_expired"), F.lit(False))).drop("_expired"),
        "baselines": baselines.withColumn("_gone", old_base), "runs": runs.withColumn("_gone", old_run),
    }
    left, counts = {}, {}
    for name, df in marked.items():
        seen = Observation(f"retention of {name}")
        left[name] = df.observe(seen, F.count_if("_gone").alias("gone")).where(~F.col("_gone")).drop("_gone")
        counts[f"deleted_{name}"] = lambda seen=seen: seen.get["gone"]
    return left, counts


def suppression(incidents: DataFrame, state: DataFrame, as_of: datetime, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """incidents with should_suppress and reason, by the latest unresolved row of state with the same key: flagged, or alerted within the cooldown."""
    w = Window.partitionBy("incident_key").orderBy(F.col("last_detected_at").desc_nulls_last(), F.col("alert_sent_at").desc_nulls_last())
    latest = state.where(F.col("resolved_at").isNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("incident_key", F.coalesce("is_suppressed", F.lit(False)).alias("_flag"), F.col("suppression_reason").alias("_reason"), F.col("alert_sent_at").alias("_sent"))
    minutes = age(F.col("_sent"), as_of, MINUTE)
    cooling = F.coalesce(minutes < cfg.cooldown_hours * 60, F.lit(False))
    both = incidents.join(latest, "incident_key", "left").withColumn("_flag", F.coalesce("_flag", F.lit(False)))
    reason = F.when(F.col("_flag"), F.col("_reason")).when(cooling, F.concat(F.lit("Alert sent "), F.round(minutes, 0).cast("bigint").cast("string"), F.lit(" minutes ago")))
    return both.withColumns({"should_suppress": F.col("_flag") | cooling, "reason": reason}).drop("_flag", "_reason", "_sent")


def alertable(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to alert on, suppressed) of suppression()."""
    return decided.where(~F.col("should_suppress")), decided.where("should_suppress")


def mark(incidents: DataFrame, keys: list[str], as_of: datetime, what: str, note: str | None = None) -> DataFrame:
    """Incidents with those of the keys marked: sent (note: the channel), suppressed (note: the reason) or unsuppressed."""
    own = F.col("incident_key").isin(keys) & F.col("resolved_at").isNull()
    new = {"sent": {"alert_sent_at": at(as_of), "alert_channel": F.lit(note)}, "suppressed": {"is_suppressed": F.lit(True), "suppression_reason": F.lit(note)}, "unsuppressed": {"is_suppressed": F.lit(False), "suppression_reason": F.lit(None).cast("string")}}[what]
    return incidents.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in new.items()})


def mark_all(incidents: DataFrame, keys: DataFrame, as_of: datetime, channel: str) -> DataFrame:
    """Incidents with the open ones among keys (incident_key) marked as sent: the form for many keys."""
    own = incidents.join(keys.select("incident_key", F.lit(True).alias("_sent")).distinct(), "incident_key", "left")
    sent = F.col("_sent").isNotNull() & F.col("resolved_at").isNull()
    new = {"alert_sent_at": at(as_of), "alert_channel": F.lit(channel)}
    return own.withColumns({c: F.when(sent, v).otherwise(F.col(c)) for c, v in new.items()}).select(*incidents.columns)


def worst_first(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(rank(F.col("severity")), F.col("last_detected_at").desc_nulls_last(), "incident_key")


def category(metric: Column) -> Column:
    has = lambda *xs: F.greatest(*[metric.contains(x) for x in xs])
    return F.when(has("revenue", "order", "aov"), "revenue").when(has("rate", "conversion"), "conversion").when(has("funnel", "break", "missing"), "pipeline").otherwise("other")


def group_incidents(incidents: DataFrame) -> DataFrame:
    """One row for each category: its worst and latest incident, how many more there are, and all metrics in that order."""
    order = F.struct(rank(F.col("severity")).alias("r"), (-F.unix_micros(F.col("last_detected_at").cast("timestamp"))).alias("t"), F.col("incident_key").alias("k"))
    rows = incidents.withColumn("category", category(F.col("metric_name"))).withColumn("_o", order)
    return rows.groupBy("category").agg(
        F.min_by("incident_key", "_o").alias("incident_key"), F.min_by("metric_name", "_o").alias("metric_name"), F.min_by("severity", rank(F.col("severity"))).alias("severity"), (F.count(F.lit(1)) - 1).alias("related_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "metric_name"))), lambda x: x["metric_name"]).alias("grouped_metrics"),
    )


def group_members(incidents: DataFrame) -> DataFrame:
    """Each incident as a row of its group: category, the group's primary incident, and whether it is that. Groups of any size: the one thing that is gathered is a primary for each category."""
    order = F.struct(rank(F.col("severity")).alias("r"), (-F.unix_micros(F.col("last_detected_at").cast("timestamp"))).alias("t"), F.col("incident_key").alias("k"))
    rows = incidents.withColumn("category", category(F.col("metric_name")))
    first = rows.groupBy("category").agg(F.min_by("incident_key", order).alias("primary_key"))
    return rows.join(F.broadcast(first), "category").select("category", "incident_key", "metric_name", "severity", "primary_key", (F.col("incident_key") == F.col("primary_key")).alias("is_primary"))


def suppression_stats(incidents: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row of counts over the incidents seen in the last hours."""
    recent = incidents.where(F.col("last_detected_at") >= at(as_of - timedelta(hours=hours)))
    held, done = F.coalesce(F.col("is_suppressed"), F.lit(False)), F.col("resolved_at").isNotNull()
    return recent.agg(F.count_if(held).alias("suppressed_count"), F.count_if(~held & ~done).alias("active_count"), F.count_if(done).alias("resolved_count"), F.count_if(F.col("alert_sent_at").isNotNull()).alias("alerted_count"))


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))
