"""Temporary views of the metric layer over a session's events, and a check that they are there."""

from __future__ import annotations

import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config import DetectionConfig
from ..operators import baselines, lifecycle, metrics, rollup, rules, statistical
from ..schema import INCIDENTS, currencies, event_types, metric_definitions
from . import run_routine

VIEWS = ("dim_currency", "dim_event_type", "metric_definitions", "v_hourly_event_counts", "v_hourly_funnel", "v_hourly_conversion_rates", "v_hourly_revenue", "v_hourly_revenue_per_session", "v_hourly_metrics", "v_metrics_long", "v_current_baselines", "v_metrics_with_baseline", "v_same_hour_baseline", "v_zscore_anomalies", "v_iqr_anomalies", "v_active_incidents", "v_incident_summary", "v_hour_visitors", "root_cause_patterns")
# Arguments and columns of the set-returning routines.
ROUTINES = {
    "compute_rolling_stats": ("metric STRING, current_hour TIMESTAMP_NTZ, periods INT", "rolling_mean DOUBLE, rolling_std DOUBLE, rolling_min DOUBLE, rolling_max DOUBLE, percentile_25 DOUBLE, percentile_50 DOUBLE, percentile_75 DOUBLE, iqr DOUBLE, sample_count BIGINT"),
    "get_baseline_for_metric": ("metric STRING, asked_at TIMESTAMP_NTZ", "baseline_mean DOUBLE, baseline_std DOUBLE, baseline_q1 DOUBLE, baseline_q3 DOUBLE, baseline_iqr DOUBLE, sample_count BIGINT"),
    run_routine.NAME: (run_routine.ARGUMENTS, run_routine.COLUMNS),
}


def register(spark: SparkSession, events: DataFrame, as_of: datetime, history: DataFrame | None = None, incidents: DataFrame | None = None, cfg: DetectionConfig = DetectionConfig()) -> None:
    """Create every view and routine; baselines are those as of a time, or the latest of a stored history; without incidents their views are empty."""
    incidents = spark.createDataFrame([], INCIDENTS) if incidents is None else incidents
    counts = metrics.event_counts(events)
    steps, money = metrics.funnel(counts), metrics.revenue(events)
    wide = metrics.hourly_metrics(events)
    long = metrics.metrics_long(wide)
    current = baselines.current_baselines(history) if history is not None else baselines.rolling_baseline(long, as_of)
    rows = baselines.metrics_with_baseline(long, current)
    frames = (currencies(spark), event_types(spark), metric_definitions(spark), counts, steps, metrics.conversion_rates(steps), money, metrics.revenue_per_session(steps, money), wide, long, current, rows, baselines.same_hour_window(long), statistical.zscore_view(rows), statistical.iqr_view(rows), lifecycle.active_incidents(incidents, as_of), lifecycle.incident_summary(incidents, as_of), rules.hour_visitors(events), rollup.default_patterns(spark))
    for name, df in zip(VIEWS, frames, strict=True):
        df.createOrReplaceTempView(name)
    (current if history is None else history).createOrReplaceTempView("metric_baselines")
    q = "percentile(m.metric_value, {})".format
    bodies = {
        "compute_rolling_stats": f"SELECT avg(m.metric_value), stddev_samp(m.metric_value), min(m.metric_value), max(m.metric_value), {q(0.25)}, {q(0.5)}, {q(0.75)}, {q(0.75)} - {q(0.25)}, count(*) FROM v_metrics_long m WHERE m.metric_name = compute_rolling_stats.metric AND m.hour_ts >= compute_rolling_stats.current_hour - make_interval(0, 0, 0, 0, compute_rolling_stats.periods) AND m.hour_ts < compute_rolling_stats.current_hour",
        "get_baseline_for_metric": "SELECT b.s.* FROM (SELECT max_by(struct(rolling_mean, rolling_std, percentile_25, percentile_75, iqr, sample_count), computed_at) AS s FROM metric_baselines WHERE metric_name = get_baseline_for_metric.metric AND computed_at <= get_baseline_for_metric.asked_at) b WHERE b.s IS NOT NULL",
        run_routine.NAME: run_routine.body(cfg),
    }
    for name, (arguments, columns) in ROUTINES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {bodies[name]}")


def missing(spark: SparkSession, names=VIEWS, routines=tuple(ROUTINES)) -> list[str]:
    """Views, tables and routines that a session lacks."""
    return [n for n in names if not spark.catalog.tableExists(n)] + [n for n in routines if not spark.catalog.functionExists(n)]


def run_sql(spark: SparkSession, statements: list[str]) -> int:
    """Run statements in order, up to the first error, which is raised; how many ran."""
    for k, text in enumerate(statements):
        try:
            spark.sql(text)
        except Exception as e:
            raise RuntimeError(f"statement {k + 1} of {len(statements)} failed") from e
    return len(statements)


def run_files(spark: SparkSession, folder: str) -> list[str]:
    """Run the .sql files of a folder by name, statements parted by semicolons at line ends; the files that ran."""
    done = []
    for path in sorted(Path(folder).glob("*.sql")):
        statements = [x.strip() for x in re.split(r";[ \t]*(?:\n|$)", path.read_text(encoding="utf-8"))]
        run_sql(spark, [x for x in statements if x])
        done.append(path.name)
    return done
