"""Anomalies to incidents: severity, related metrics, root-cause hints, and the merge with incidents that are open."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..schema import DEFAULT_HINT, HINTS, PATTERNS, rank
from .baselines import at, hours


def incident_key(metric: str = "metric_name", t: str = "metric_timestamp") -> Column:
    return F.concat(F.col(metric), F.lit("_"), F.date_format(F.date_trunc("hour", F.col(t)), "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))


#: Conditions of a pattern, as JSON: what a metric's name begins with (a LIKE prefix, so _ stands for any character), the direction, and severities (none: any).
CONDITIONS = "array<struct<metric: string, direction: string, severity: array<string>>>"
PATTERN = "name string, priority int, hint string, active boolean, position int, conditions string"


def default_patterns(spark: SparkSession) -> DataFrame:
    """The built-in patterns as a table: of equal priorities the smaller position wins."""
    text = lambda conditions: json.dumps([{"metric": m, "direction": d, "severity": list(s)} for m, d, s in conditions])
    return spark.createDataFrame([(name, priority, HINTS[name], True, k, text(conditions)) for k, (name, priority, conditions) in enumerate(PATTERNS)], PATTERN)


def root_cause_hints(anomalies: DataFrame, honour_severity: bool = False, patterns: DataFrame | None = None) -> DataFrame:
    """(metric_timestamp, root_cause_hint): that of the active pattern of highest priority of which every condition is met by some anomaly of the time.

    By division: conditions meet the distinct (metric, direction, severity) by length and text of what they begin with, then times; a pattern fits where as many of its conditions are met as it has. The plan is the same for any
    number of patterns. A pattern without conditions always fits, one whose conditions aren't such JSON never."""
    patterns = default_patterns(anomalies.sparkSession) if patterns is None else patterns
    own = patterns.where("active").select("position", F.struct("priority", (-F.col("position")).alias("earlier"), "hint").alias("told"), F.from_json("conditions", CONDITIONS).alias("conditions"))
    each = own.select("position", F.posexplode("conditions").alias("number", "c")).select("position", "number", F.col("c.metric").alias("prefix"), F.col("c.direction").alias("direction"), F.col("c.severity").alias("severities"))
    head = F.regexp_extract("prefix", r"^[^_%\\]*", 0)
    each = each.where("prefix is not null").select("*", head.alias("head"), F.length(head).alias("n"))
    seen = anomalies.select("metric_timestamp", "metric_name", "direction", "severity").distinct()
    kinds = seen.select("metric_name", "direction", "severity").distinct()
    begun = kinds.select("*", F.explode(F.sequence(F.lit(0), F.length("metric_name"))).alias("n")).withColumn("head", F.expr("substring(metric_name, 1, n)"))
    met = begun.join(each, ["n", "head", "direction"]).where(F.expr("metric_name LIKE concat(prefix, '%')"))
    if honour_severity:
        met = met.where("severities is null or size(severities) = 0 or array_contains(severities, severity)")
    times = seen.join(met.select("metric_name", "direction", "severity", "position", "number"), ["metric_name", "direction", "severity"])
    whole = times.groupBy("metric_timestamp", "position").agg(F.count_distinct("number").alias("met")).join(own.select("position", "told", F.size("conditions").alias("needed")), "position").where("met = needed")
    best = whole.groupBy("metric_timestamp").agg(F.max("told").alias("told"))
    always = own.where("size(conditions) = 0").agg(F.max("told").alias("always"))
    every = seen.select("metric_timestamp").distinct().join(best, "metric_timestamp", "left").join(F.broadcast(always))  # one row
    return every.select("metric_timestamp", F.coalesce(F.greatest("told", "always")["hint"], F.lit(DEFAULT_HINT)).alias("root_cause_hint"))


def related_metrics(anomalies: DataFrame) -> DataFrame:
    """(metric_name, metric_timestamp, related_metrics): the others found at that time, null if none."""
    names = anomalies.groupBy("metric_timestamp").agg(F.collect_set("metric_name").alias("names"))
    each = anomalies.select("metric_name", "metric_timestamp").distinct().join(names, "metric_timestamp")
    others = F.array_sort(F.array_remove("names", F.col("metric_name")))
    return each.select("metric_name", "metric_timestamp", F.when(F.size(others) > 0, others).alias("related_metrics"))


def incidents_of(anomalies: DataFrame, cfg: DetectionConfig = DetectionConfig(), patterns: DataFrame | None = None) -> DataFrame:
    """One candidate incident for each metric and time."""
    worst = F.max("severity") if cfg.severity_mode == "lexicographic" else F.min_by("severity", rank(F.col("severity")))
    groups = anomalies.groupBy("metric_name", "metric_timestamp").agg(
        worst.alias("severity"), F.array_sort(F.collect_set("detector")).alias("detectors"), F.max("current_value").alias("current_value"), F.max("baseline_mean").alias("baseline_value"),
        F.max("pct_change").alias("deviation_pct"), F.count(F.lit(1)).alias("detection_count"), F.array_join(F.array_sort(F.collect_set("description")), " | ").alias("combined_description"),
    )
    names = anomalies.groupBy("metric_timestamp").agg(F.collect_set("metric_name").alias("names"))
    told = names.join(root_cause_hints(anomalies, cfg.honour_pattern_severity, patterns), "metric_timestamp")
    others = F.array_sort(F.array_remove("names", F.col("metric_name")))
    return groups.join(told, "metric_timestamp").select(
        incident_key().alias("incident_key"), "metric_name", "metric_timestamp", "severity", "detectors", "detection_count", "current_value", "baseline_value", "deviation_pct", "combined_description", "root_cause_hint", F.when(F.size(others) > 0, others).alias("related_metrics")
    )


def upsert(old: DataFrame, new: DataFrame, as_of: datetime, cfg: DetectionConfig = DetectionConfig(), seen: bool = False) -> DataFrame:
    """Incidents after a run: a candidate goes into the open incident of its key seen in the last match_hours, or becomes one.

    seen: the run was merged before; incidents last seen at its time aren't counted again. Adds column is_new; an incident is kept as it is where nothing matches."""
    now = at(as_of)
    c = new.select("incident_key", *[F.col(x).alias(f"n_{x}") for x in ("metric_name", "severity", "detection_count", "current_value", "baseline_value", "deviation_pct", "root_cause_hint", "related_metrics")])
    fresh = F.col("resolved_at").isNull() & (F.col("last_detected_at") >= now - hours(cfg.match_hours))
    live = old.withColumn("_match", F.when(F.coalesce(fresh, F.lit(False)), F.col("incident_key")))
    both = live.join(c.withColumnRenamed("incident_key", "_key"), F.col("_match") == F.col("_key"), "full_outer")
    hit, made = F.col("_match").isNotNull() & F.col("_key").isNotNull(), F.col("incident_key").isNull()
    severity = F.when((F.col("n_severity") == "critical") | (F.col("severity") == "critical"), "critical").otherwise(F.col("n_severity"))
    keep = lambda name, when_hit, when_made: F.when(made, when_made).when(hit, when_hit).otherwise(F.col(name)).alias(name)
    none = F.lit(None)
    n = lambda x: F.col(f"n_{x}")
    rest = [x for x in ("alert_sent_at", "alert_channel", "is_suppressed", "suppression_reason", "resolved_at", "resolution_notes") if x in old.columns]
    return both.select(
        F.coalesce("incident_key", "_key").alias("incident_key"), keep("first_detected_at", F.col("first_detected_at"), now), keep("last_detected_at", now, now), keep("metric_name", F.col("metric_name"), n("metric_name")),
        keep("severity", severity, n("severity")), keep("detection_count", F.col("detection_count") + (F.when(F.col("last_detected_at") == now, 0).otherwise(1) if seen else 1), n("detection_count")), keep("current_value", n("current_value"), n("current_value")), keep("baseline_value", F.col("baseline_value"), n("baseline_value")),
        keep("deviation_pct", n("deviation_pct"), n("deviation_pct")), keep("root_cause_hint", F.coalesce(n("root_cause_hint"), F.col("root_cause_hint")), n("root_cause_hint")), keep("related_metrics", F.coalesce(n("related_metrics"), F.col("related_metrics")), n("related_metrics")),
        *[keep(x, F.col(x), F.lit(False) if x == "is_suppressed" else none) for x in rest], made.alias("is_new"),
    )
