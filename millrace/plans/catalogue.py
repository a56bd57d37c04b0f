"""Registered monitoring queries: each operator over the test tables, in a form that SQL can state again.

Thresholds of the rules are lowered (``SCALED``), as the test tables have few events an hour, and every hour is a window of its own.
State that a running monitor would have (alerts sent, suppressions, runs) is made from the rows themselves, the same way in both engines.
"""

from __future__ import annotations

import functools
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AlertConfig, DetectionConfig, RetentionConfig, Window
from ..functions import sql_surface
from ..operators import baselines, health, lifecycle, metrics, partials, rollup, rules, statistical
from ..operators.baselines import at
from ..schema import event_types
from ..sources.adapter import injected, orders, read_events
from ..sources.tables import kept, scratch
from . import backtest, pipeline, state, stored
from .oracles import ORACLES

DETECT_ALERTS = AlertConfig()
AS_OF = datetime(2024, 1, 30)
DAY = Window(datetime(2024, 1, 29), AS_OF)
WEEK = Window(datetime(2024, 1, 23), AS_OF)
SCALED = DetectionConfig(missing_baseline=1, funnel_success=2, funnel_complete=2, gateway_initiated=2, gateway_hour_initiated=2, traffic_users=2, revenue_baseline=10)
QUERIES: dict = {}
__all__ = ["ORACLES", "QUERIES"]


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _wide(spark, d):
    return metrics.hourly_metrics(read_events(spark, d))


def _long(spark, d):
    return metrics.metrics_long(_wide(spark, d))


def _compared(spark, d):
    long = _long(spark, d)
    return baselines.metrics_with_baseline(long, baselines.rolling_baseline(long, AS_OF))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("z_score", "pct_change_from_mean", "iqr_distance", "iqr_lower_bound", "iqr_upper_bound") if c in df.columns})


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("description", "metadata_json")


def _injected(spark, d):
    return injected(read_events(spark, d))


def _history(spark, d):
    """Baselines of four runs."""
    long = kept(_long(spark, d))
    out = None
    for day in (9, 16, 23, 30):
        one = baselines.rolling_baseline(long, datetime(2024, 1, day))
        out = one if out is None else out.unionByName(one)
    return out


def _anomalies(spark, d):
    """Anomalies of a week: both statistical families and the rules, of the events with faults; metrics and anomalies are written once."""
    events = _injected(spark, d)
    facts = kept(metrics.facts(events))
    long = kept(metrics.metrics_long(metrics.wide_of(metrics.tally(facts))))
    rows = baselines.metrics_with_baseline(long, baselines.rolling_baseline(long, AS_OF))
    ruled = rules.all_rules(None, cfg=SCALED, facts=facts)
    return kept(statistical.all_statistical(rows, WEEK).unionByName(ruled.where((F.col("metric_timestamp") >= at(WEEK.start)) & (F.col("metric_timestamp") < at(WEEK.end)))))


def _state(spark, d, anomalies=None):
    """Incidents as a monitor would hold them: seen an hour after their time, some alerted, suppressed or resolved by the length of their key."""
    n = F.length("metric_name") + F.hour("metric_timestamp")
    t = F.col("metric_timestamp")
    c = rollup.incidents_of(_anomalies(spark, d) if anomalies is None else anomalies)
    return c.select(
        "incident_key", t.alias("first_detected_at"), (t + baselines.hours(1)).alias("last_detected_at"), "metric_name", "severity", "detection_count", "current_value", "baseline_value", "deviation_pct", "root_cause_hint", "related_metrics",
        F.when(n % 3 == 0, t + baselines.hours(2)).alias("alert_sent_at"), F.lit(None).cast("string").alias("alert_channel"), (n % 5 == 0).alias("is_suppressed"), F.when(n % 5 == 0, "muted").alias("suppression_reason"),
        F.when(n % 7 == 0, t + baselines.hours(3)).alias("resolved_at"), F.lit(None).cast("string").alias("resolution_notes"),
    )


def _runs(spark, d):
    """A run for each hour of events."""
    n = F.hour("window_start") + F.dayofmonth("window_start")
    w = rules.hourly_windows(read_events(spark, d))
    failed = n % 6 == 0
    return w.select(
        F.date_format("window_start", "yyyyMMddHH").alias("run_id"), F.col("window_end").alias("started_at"), F.when(~failed, F.col("window_end") + F.make_interval(secs=(n * 7).cast("decimal(18,6)"))).alias("ended_at"), "window_start", "window_end",
        F.when(failed, "failed").otherwise("completed").alias("status"), F.lit(168).alias("baseline_periods"), F.lit(18).alias("metrics_computed"), F.when(~failed, n % 4).cast("int").alias("anomalies_detected"), F.when(failed, "error").alias("error_message"),
    )


@query
def q_event_distribution(spark, d):
    return read_events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "event_type")


@query
def q_data_range(spark, d):
    return read_events(spark, d).agg(F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), F.count(F.lit(1)).alias("events"))


@query
def q_hourly_event_counts(spark, d):
    return metrics.event_counts(read_events(spark, d))


@query
def q_hourly_funnel(spark, d):
    return metrics.funnel(metrics.event_counts(read_events(spark, d)))


@query
def q_conversion_rates(spark, d):
    return metrics.conversion_rates(metrics.funnel(metrics.event_counts(read_events(spark, d))))


@query
def q_hourly_revenue(spark, d):
    return metrics.revenue(read_events(spark, d))


@query
def q_revenue_per_session(spark, d):
    events = read_events(spark, d)
    return metrics.revenue_per_session(metrics.funnel(metrics.event_counts(events)), metrics.revenue(events))


@query
def q_hourly_metrics_wide(spark, d):
    return _wide(spark, d)


@query
def q_hourly_metrics_joined(spark, d):
    return metrics.hourly_metrics_joined(read_events(spark, d))


@query
def q_metrics_long(spark, d):
    return _long(spark, d)


@query
def q_rolling_baseline(spark, d):
    return baselines.rolling_baseline(_long(spark, d), AS_OF)


@query
def q_rolling_baseline_all_hours(spark, d):
    return baselines.rolling_baseline_all_hours(_long(spark, d))


@query
def q_current_baseline(spark, d):
    return baselines.current_baselines(_history(spark, d))


@query
def q_baseline_asof(spark, d):
    asked = _long(spark, d).select("metric_name", F.col("hour_ts").alias("asked_at"))
    return baselines.baseline_asof(_history(spark, d), asked)


@query
def q_metrics_with_baseline(spark, d):
    return _rounded(_compared(spark, d))


@query
def q_metrics_snapshot(spark, d):
    rows = _rounded(statistical.within(_compared(spark, d), DAY))
    return rows.select("hour_ts", "metric_name", "metric_value", "baseline_mean", "z_score", "pct_change_from_mean", "baseline_sample_count").orderBy(F.desc("hour_ts"), "metric_name")


@query
def q_same_hour_baseline_join(spark, d):
    return baselines.same_hour_join(_long(spark, d))


@query
def q_same_hour_baseline_window(spark, d):
    return baselines.same_hour_window(_long(spark, d))


@query
def q_zscore_view(spark, d):
    return _rounded(statistical.zscore_view(_compared(spark, d)))


@query
def q_zscore_detect(spark, d):
    return _plain(statistical.zscore(_compared(spark, d), WEEK))


@query
def q_zscore_revenue(spark, d):
    return _plain(statistical.zscore_revenue(_compared(spark, d), WEEK))


@query
def q_zscore_conversion(spark, d):
    return _plain(statistical.zscore_conversion(_compared(spark, d), WEEK))


@query
def q_zscore_all(spark, d):
    return _plain(statistical.all_zscore(_compared(spark, d), WEEK))


@query
def q_iqr_view(spark, d):
    return _rounded(statistical.iqr_view(_compared(spark, d)))


@query
def q_iqr_detect(spark, d):
    return _plain(statistical.iqr(_compared(spark, d), WEEK))


@query
def q_iqr_revenue(spark, d):
    return _plain(statistical.iqr_revenue(_compared(spark, d), WEEK))


@query
def q_aov_detect(spark, d):
    return _plain(statistical.iqr_order_value(_compared(spark, d), WEEK))


@query
def q_iqr_all(spark, d):
    return _plain(statistical.all_iqr(_compared(spark, d), WEEK))


def _rule(rule):
    def run(spark, d):
        events = _injected(spark, d)
        return _plain(rule(events, cfg=SCALED) if rule is rules.all_rules else rule(events, rules.hourly_windows(events), SCALED))

    return run


for _name, _f in (("q_missing_event_types", rules.missing_event_types), ("q_funnel_breaks", rules.funnel_breaks), ("q_payment_gateway", rules.payment_gateway), ("q_traffic_drops", rules.traffic_drops), ("q_zero_revenue", rules.zero_revenue), ("q_rules_all", rules.all_rules)):
    _run = _rule(_f)
    _run.__name__ = _name
    query(_run)


@query
def q_rules_day_window(spark, d):
    """The rules over one window of a whole day."""
    events = _injected(spark, d)
    return _plain(rules.all_rules(events, rules.one_window(events, Window(datetime(2024, 1, 22), datetime(2024, 1, 23))), SCALED))


@query
def q_anomalies_all(spark, d):
    return _plain(_anomalies(spark, d))


@query
def q_anomaly_texts(spark, d):
    return _anomalies(spark, d).select("metric_name", "metric_timestamp", "rule", "description")


@query
def q_anomaly_facts(spark, d):
    """The further facts of anomalies, read back from their JSON documents: numbers, and words where they aren't numbers."""
    facts = F.explode(F.from_json("metadata_json", "map<string,string>")).alias("fact", "value")
    number = F.expr("try_cast(value AS double)")
    return _anomalies(spark, d).select("metric_name", "metric_timestamp", "rule", facts).select("metric_name", "metric_timestamp", "rule", "fact", F.round(number, 4).alias("number"), F.when(number.isNull(), F.col("value")).alias("word"))


@query
def q_incident_texts(spark, d):
    return rollup.incidents_of(_anomalies(spark, d)).select("incident_key", "combined_description", "root_cause_hint")


@query
def q_run_log(spark, d):
    """The log of one run that completes and one that fails."""
    events = read_events(spark, d)
    result = pipeline.run(events, WEEK, AS_OF, cfg=SCALED)
    done = pipeline.run_record(events, result, WEEK, AS_OF, AS_OF + timedelta(seconds=90), cfg=SCALED)
    failed = pipeline.run_record(events, None, WEEK, AS_OF, AS_OF + timedelta(seconds=5), error="no events", cfg=SCALED)
    return done.unionByName(failed).drop("run_id")


@query
def q_run_summary(spark, d):
    events = read_events(spark, d)
    result = pipeline.run(events, WEEK, AS_OF, cfg=SCALED)
    return result.summary.drop("run_id")


@query
def q_topk_anomalies(spark, d):
    found = _anomalies(spark, d).where("z_score is not null")
    return found.orderBy(F.abs("z_score").desc(), "metric_name", "metric_timestamp", "rule").limit(20).select("metric_name", "metric_timestamp", "rule", "severity", "z_score")


def _text(df: DataFrame) -> DataFrame:
    """Arrays as text, so both engines hash them alike."""
    return df.withColumns({c: F.array_join(c, ",") for c, t in df.dtypes if t == "array<string>"}).drop("combined_description", "root_cause_hint")


@query
def q_incident_rollup(spark, d):
    return _text(rollup.incidents_of(_anomalies(spark, d)))


@query
def q_incident_severity_lexicographic(spark, d):
    return _text(rollup.incidents_of(_anomalies(spark, d), replace(SCALED, severity_mode="lexicographic"))).select("incident_key", "severity")


@query
def q_related_metrics(spark, d):
    return _text(rollup.related_metrics(_anomalies(spark, d)))


@query
def q_root_cause_hint(spark, d):
    return rollup.root_cause_hints(_anomalies(spark, d))


@query
def q_incident_upsert(spark, d):
    """A rerun of the week's last two days over the incidents of the state."""
    anomalies = _anomalies(spark, d)
    found = anomalies.where(F.col("metric_timestamp") >= at(datetime(2024, 1, 28)))
    return _text(rollup.upsert(_state(spark, d, anomalies), rollup.incidents_of(found), AS_OF))


@query
def q_active_incidents(spark, d):
    return _text(lifecycle.active_incidents(_state(spark, d), AS_OF)).drop("alert_channel", "suppression_reason", "resolved_at", "resolution_notes")


@query
def q_incident_summary(spark, d):
    return lifecycle.incident_summary(_state(spark, d), AS_OF)


@query
def q_resolve_stale(spark, d):
    return lifecycle.resolve_stale(_state(spark, d), AS_OF).select("incident_key", "resolved_at")


def _dated(spark, d):
    return _anomalies(spark, d).select(F.date_format("metric_timestamp", "yyyyMMddHH").alias("run_id"), F.col("metric_timestamp").alias("detected_at"), "metric_name", "rule", "severity")


RETAIN = RetentionConfig(anomalies_days=3, baselines_days=10, runs_days=5)


@query
def q_cleanup_anomalies(spark, d):
    return lifecycle.cleanup_anomalies(_dated(spark, d), AS_OF, 3)


@query
def q_retention(spark, d):
    return lifecycle.apply_retention(_dated(spark, d), _runs(spark, d), _history(spark, d), AS_OF, RETAIN)[3]


@query
def q_suppression(spark, d):
    state = kept(_state(spark, d))
    return lifecycle.suppression(state.select("incident_key", "metric_name", "severity"), state, datetime(2024, 1, 28), DETECT_ALERTS).select("incident_key", "should_suppress", "reason")


@query
def q_suppression_stats(spark, d):
    return lifecycle.suppression_stats(_state(spark, d), AS_OF)


@query
def q_group_incidents(spark, d):
    return lifecycle.group_incidents(_state(spark, d)).withColumn("grouped_metrics", F.array_join("grouped_metrics", ","))


@query
def q_backtest_windows(spark, d):
    return _plain(backtest.replay(_injected(spark, d), SCALED))


@query
def q_backtest_matches(spark, d):
    events = _injected(spark, d)
    return backtest.evaluate(backtest.replay(events, SCALED), backtest.known_windows(events))[0]


@query
def q_backtest_eval(spark, d):
    events = _injected(spark, d)
    scored = backtest.evaluate(backtest.replay(events, SCALED), backtest.known_windows(events))[1]
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@query
def q_health_freshness(spark, d):
    return health.freshness(read_events(spark, d), AS_OF)


@query
def q_health_runs(spark, d):
    return health.recent_runs(_runs(spark, d), AS_OF)


@query
def q_incident_queue(spark, d):
    return health.incident_queue(_state(spark, d))


@query
def q_run_stats(spark, d):
    return health.run_statistics(_runs(spark, d), AS_OF)


@query
def q_insert_if_absent(spark, d):
    rows = read_events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    dim = event_types(spark).select("event_type", F.col("funnel_order").cast("bigint").alias("n")).where("funnel_order <= 4")
    return lifecycle.insert_if_absent(dim, rows, ["event_type"])


@query
def q_zero_amount_orders(spark, d):
    return orders(spark, d).where("amount < 5000").select("order_id", F.col("amount").cast("double").alias("amount"), "status")


@query
def q_unpaid_orders(spark, d):
    """Orders without an amount; the test tables may have none."""
    return orders(spark, d).where("amount = 0").select("order_id", F.col("amount").cast("double").alias("amount"), "status")


def _stored(spark, d, fault=lambda e: e):
    """The hourly store of all events, of which every seventh arrives late, after a first refresh."""
    store = stored.Hourly(spark, scratch(spark))
    events = fault(read_events(spark, d))
    late = F.col("event_id") % 7 == 0
    for part in (events.where(~late), events.where(late)):
        store.arrive(part)
        store.refresh()
    return store


@query
def q_stored_event_counts(spark, d):
    return metrics.counts_of(_stored(spark, d).tally())


@query
def q_stored_metrics_wide(spark, d):
    return _stored(spark, d).wide()


@query
def q_stored_rules(spark, d):
    store = _stored(spark, d, injected)
    return _plain(partials.all_rules(store.sums(), store.marks(), cfg=SCALED))


@query
def q_weekly_visitors(spark, d):
    """Distinct users and sessions of each week and type, by merging the bitmaps of its hours; orders and paying sessions of purchases."""
    week = F.date_trunc("week", "hour_ts").cast("timestamp_ntz")
    return partials.across(_stored(spark, d).marks().withColumn("week", week), "week", "event_type")


@query
def q_rerun(spark, d):
    """A week's run over a stored state, run a second time: its anomalies replace those of the first."""
    store = state.State(spark, scratch(spark))
    events = read_events(spark, d)
    state.run(store, events, WEEK, AS_OF, SCALED)
    state.run(store, events, WEEK, AS_OF, SCALED)
    by = lambda x: F.count_if(F.col("detector") == x)
    found = store.read("anomalies").agg(by("zscore").alias("zscore_anomalies"), by("iqr").alias("iqr_anomalies"), by("rules").alias("rules_anomalies"), F.count(F.lit(1)).alias("total_anomalies"), F.count_distinct("metric_name", "metric_timestamp").alias("candidate_incidents"))
    kept_ = store.read("incidents").agg(F.count(F.lit(1)).alias("incidents"), F.sum("detection_count").alias("detections"))
    return found.join(F.broadcast(kept_)).join(F.broadcast(store.read("runs").agg(F.count(F.lit(1)).alias("runs"))))


@query
def q_pattern_table(spark, d):
    """Hints by a table of patterns: the built-in ones, one of them switched off, and three more."""
    more = [("any_funnel_break", 200, "A step of the funnel lacks the one before.", True, 100, '[{"metric": "funnel_break", "direction": "missing", "severity": []}]'), ("off", 300, "Never told.", False, 101, '[{"metric": "", "direction": "missing"}]'), ("odd_wildcard", 150, "Revenue of any kind is low.", True, 102, '[{"metric": "_ero_rev", "direction": "below"}, {"metric": "gross", "direction": "below"}]')]
    table = rollup.default_patterns(spark).withColumn("active", F.col("name") != "payment_gateway_down").unionByName(spark.createDataFrame(more, rollup.PATTERN))
    return rollup.root_cause_hints(_anomalies(spark, d), patterns=table)


@query
def q_sql_pipeline(spark, d):
    """The run of q_run_summary by the SQL routine."""
    sql_surface.register(spark, read_events(spark, d), AS_OF, cfg=SCALED)
    return spark.sql("SELECT * FROM run_full_detection_pipeline(TIMESTAMP_NTZ'2024-01-23 00:00:00', TIMESTAMP_NTZ'2024-01-30 00:00:00', 168)").drop("run_id")


@query
def q_group_members(spark, d):
    return lifecycle.group_members(_state(spark, d))


@query
def q_anomaly_ids(spark, d):
    return _anomalies(spark, d).select(statistical.identity(F.lit("week")).alias("anomaly_id"), "metric_name", "metric_timestamp", "rule")


@query
def q_injected_unpaid_orders(spark, d):
    """Orders without an amount where every 97th has lost it."""
    lost = F.when(F.col("order_id") % 97 == 0, F.lit(0).cast("decimal(12,2)")).otherwise(F.col("amount"))
    return orders(spark, d).withColumn("amount", lost).where("amount = 0").select("order_id", F.col("amount").cast("double").alias("amount"), "status")
