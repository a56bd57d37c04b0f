"""A detection run: baselines, detectors, incidents and the run's record, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig, Window
from ..operators import baselines, metrics, rollup, rules, statistical
from ..schema import RUNS
from ..sources.tables import kept


@dataclass
class Result:
    run_id: str
    baselines: DataFrame
    anomalies: DataFrame
    incidents: DataFrame | None = None
    summary: DataFrame | None = None


def run_id_of(window: Window, as_of: datetime) -> str:
    return f"run-{window.start:%Y%m%d%H%M%S}-{window.end:%Y%m%d%H%M%S}-{as_of:%Y%m%d%H%M%S}"


def detect(events: DataFrame, window: Window, cfg: DetectionConfig = DetectionConfig(), history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(baselines, anomalies) of a window. history: stored baselines, which stand in for metrics that have too few samples now.

    Only events that the longest look-back can reach are read."""
    reach = events.where((F.col("event_time") >= baselines.at(window.start) - baselines.hours(max(28 * 24, cfg.baseline_hours))) & (F.col("event_time") < baselines.at(window.end)))
    facts = kept(metrics.facts(reach))
    long = kept(metrics.metrics_long(metrics.wide_of(metrics.tally(facts))))
    return judged(long, rules.all_rules(None, rules.one_window(events, window), cfg, facts), window, cfg, history)


def judged(long: DataFrame, ruled: DataFrame, window: Window, cfg: DetectionConfig, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(baselines, anomalies) of a window from the long metrics that the baselines reach and what the rules found."""
    base = baselines.rolling_baseline(long, window.end if cfg.baseline_end == "window_end" else window.start, cfg.baseline_hours, cfg.min_samples)
    current = baselines.current_baselines(base if history is None else history.select(*base.columns).unionByName(base))
    rows = baselines.metrics_with_baseline(long, current, cfg.iqr_multiplier)
    return base, statistical.all_statistical(rows, window, cfg).unionByName(ruled)


def rolled(result: Result, as_of: datetime, open_incidents: DataFrame | None, cfg: DetectionConfig, seen: bool = False, patterns: DataFrame | None = None) -> Result:
    """result with the incidents and counts of its anomalies. seen: these anomalies have been merged before, at that time."""
    new = rollup.incidents_of(result.anomalies, cfg, patterns)
    incidents = rollup.upsert(open_incidents, new, as_of, cfg, seen) if open_incidents is not None else new
    by = lambda d: F.count_if(F.col("detector") == d)
    summary = result.anomalies.agg(by("zscore").alias("zscore_anomalies"), by("iqr").alias("iqr_anomalies"), by("rules").alias("rules_anomalies"), F.count(F.lit(1)).alias("total_anomalies"), F.count_distinct("metric_name", "metric_timestamp").alias("candidate_incidents"))
    return replace(result, incidents=incidents, summary=summary.select(F.lit(result.run_id).alias("run_id"), "*"))


def run(events: DataFrame, window: Window, as_of: datetime, open_incidents: DataFrame | None = None, cfg: DetectionConfig = DetectionConfig(), history: DataFrame | None = None) -> Result:
    """Everything that one run adds."""
    run_id = run_id_of(window, as_of)
    base, found = detect(events, window, cfg, history)
    return rolled(Result(run_id, base, found.select(F.lit(run_id).alias("run_id"), baselines.at(as_of).alias("detected_at"), "*")), as_of, open_incidents, cfg)


def run_record(events: DataFrame, result: Result | None, window: Window, as_of: datetime, ended_at: datetime, error: str | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """The run's row for the run log; a failed run has its error and no count."""
    spark = events.sparkSession
    count = None if error or result is None else result.summary.first()["total_anomalies"]
    row = (result.run_id if result else run_id_of(window, as_of), as_of, ended_at, window.start, window.end, "failed" if error else "completed", cfg.baseline_hours, None if error else 18, count, error)
    return spark.createDataFrame([row], RUNS)
