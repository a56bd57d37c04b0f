"""Replays of history: every hour as a window, in one plan, and their evaluation against known faults."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..operators import baselines, metrics, rules, statistical
from ..sources.tables import kept

# Known faults as (name, hours from the reference time, hours long, metrics that should be found).
KNOWN = [
    ("missing_purchase_events", -48, 3, ["purchases", "funnel_break_purchase", "checkout_to_purchase_rate"]),
    ("checkout_complete_drop", -24, 2, ["checkout_complete", "checkout_completion_rate"]),
    ("revenue_spike", -12, 1, ["gross_revenue", "avg_order_value", "revenue_per_session"]),
    ("revenue_zero", -6, 1, ["gross_revenue", "avg_order_value", "zero_revenue_bug"]),
    ("missing_event_type", -4, 2, ["add_to_cart", "add_to_cart_count"]),
]


def replay(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Anomalies of every hour from baseline_hours after the first on, each against the baseline its own run would have had.

    Events are read once, for hourly facts, which are written; the long metrics that come from them are written too, as baselines, detectors and the first hour read them; so are the anomalies."""
    facts = kept(metrics.facts(events))
    long = kept(metrics.metrics_long(metrics.wide_of(metrics.tally(facts))))
    first = long.agg(F.min("hour_ts")).first()[0]
    if first is None:
        return kept(statistical.all_statistical(baselines.compare(baselines.rolling_baseline_all_hours(long)), None, cfg))
    rows = baselines.compare(baselines.rolling_baseline_all_hours(long, cfg.baseline_hours, cfg.baseline_end, cfg.min_samples), cfg.iqr_multiplier)
    found = statistical.all_statistical(rows, None, cfg).unionByName(rules.all_rules(None, cfg=cfg, facts=facts))
    return kept(found.where(F.col("metric_timestamp") >= baselines.at(first + timedelta(hours=cfg.baseline_hours))))


def known_windows(events: DataFrame, reference: datetime | None = None) -> DataFrame:
    """Known faults as (anomaly_name, start_time, end_time, expected); their reference time is the last event's hour."""
    spark = events.sparkSession
    if reference is None:
        last = events.agg(F.max("event_time")).first()[0]
        if last is None:
            return spark.createDataFrame([], "anomaly_name string, start_time timestamp_ntz, end_time timestamp_ntz, expected array<string>")
        reference = last.replace(minute=0, second=0, microsecond=0)
    rows = [(n, reference + timedelta(hours=o), reference + timedelta(hours=o + d), e) for n, o, d, e in KNOWN]
    return spark.createDataFrame(rows, "anomaly_name string, start_time timestamp_ntz, end_time timestamp_ntz, expected array<string>")


def matched(points: DataFrame, known: DataFrame) -> DataFrame:
    """points (metric_timestamp, ...) with the windows of known that hold them, a row for each.

    Windows are sorted by length into levels, each twice as long as the one before; a level's bins are as long as its longest windows, so a window touches two bins at most, whatever its length, and points meet one bin of each level that
    occurs."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    long = F.greatest(F.lit(1), second("end_time") - second("start_time"))
    windows = known.where("end_time > start_time").select("anomaly_name", "start_time", "end_time", "expected", F.ceil(F.log2(long)).cast("int").alias("level"))
    bin_ = lambda t: F.floor(t / F.pow(F.lit(2.0), F.col("level")))
    windows = windows.select("*", F.explode(F.sequence(bin_(second("start_time")), bin_(second("end_time")))).alias("bin"))
    levels = windows.select("level").distinct()  # one for each power of two of seconds, so 40 at most
    placed = points.join(F.broadcast(levels)).withColumn("bin", bin_(second("metric_timestamp")))
    t = F.col("metric_timestamp")
    return placed.join(windows, ["level", "bin"]).where((t >= F.col("start_time")) & (t < F.col("end_time"))).drop("level", "bin")


def evaluate(detected: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each known window with its hits, one row of counts, precision, recall and F1).

    A window counts once if any expected metric's name is within that of a detection in it; false positives are detections that match no window. Detections alike in metric and time are counted first."""
    kinds = detected.groupBy("metric_name", "metric_timestamp").agg(F.count(F.lit(1)).alias("n"))
    right = F.exists("expected", lambda e: F.col("metric_name").contains(e))
    met = matched(kinds, known.distinct()).select("*", F.coalesce(right, F.lit(False)).alias("right"))
    found = met.groupBy("metric_name", "metric_timestamp").agg(F.max("right").alias("right"))
    wrong = kinds.join(found.where("right"), ["metric_name", "metric_timestamp"], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("false_positives"))
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    hits = met.groupBy("anomaly_name", "start_time", "end_time").agg(n(F.col("right")).alias("detected_expected"), n(~F.col("right")).alias("detected_other"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    per = known.select("anomaly_name", "start_time", "end_time").distinct().join(hits, ["anomaly_name", "start_time", "end_time"], "left")
    per = per.select("anomaly_name", "start_time", "end_time", zero("detected_expected"), zero("detected_other")).withColumn("hit", F.col("detected_expected") > 0)
    totals = per.agg(F.count_if("hit").alias("true_positives"), F.count_if(~F.col("hit")).alias("false_negatives"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    both = totals.withColumn("one", F.lit(1)).join(wrong.withColumn("one", F.lit(1)), "one").drop("one")
    scored = both.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)), "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return per, scored.withColumn("f1_score", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
