"""The monitor as a stream: exact hourly facts as keyed state, detectors on hours as they close, a sink that a batch may be written to twice.

A fact (hour, type, kind, id) is a group of the streaming aggregation, so distinct users, sessions and orders are the state's own keys: exact, and a busy hour is spread over its ids. An hour's facts leave the state
together once the watermark has passed its end. Each batch writes the facts of the hours that it closes, and then their anomalies, under its own number: a batch that is run again after a crash replaces what it wrote.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..operators import baselines, metrics, rules, statistical
from ..sources.tables import kept

FACTS = "hour_ts timestamp_ntz, event_type string, kind string, id string, n bigint, cents bigint, paid_cents bigint, paid bigint"
#: Days that baselines and rules look back, at most.
REACH = 28


def hourly_facts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``metrics.facts`` of a stream: an hour's facts come once, when events are later than ``late`` past its end; what comes for it afterwards is left out."""
    paid = (F.col("event_type") == "purchase") & (F.col("amount") > 0)
    own = lambda kind, id_, when=F.lit(True): F.when(when & id_.isNotNull(), F.struct(F.lit(kind).alias("kind"), id_.alias("id")))
    each = F.array_compact(F.array(own("type", F.lit("")), own("user", F.col("user_id")), own("session", F.col("session_id")), own("order", F.col("order_id"), paid), own("buyer", F.col("session_id"), paid)))
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    rows = timed.select("event_time", "event_type", metrics.cents().alias("cents"), F.when(F.col("amount") > 0, metrics.cents()).alias("money"), F.explode(each).alias("f"))
    sums = rows.groupBy(F.window("event_time", "1 hour"), "event_type", F.col("f.kind").alias("kind"), F.col("f.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum("money").alias("paid_cents"), F.count("money").alias("paid"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("hour_ts"), "event_type", "kind", "id", "n", "cents", "paid_cents", "paid")


class Monitor:
    """What closed hours leave in a folder: facts and anomalies, each by batch."""

    def __init__(self, spark: SparkSession, path: str, cfg: DetectionConfig = DetectionConfig()):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg

    def facts(self) -> DataFrame:
        return self.spark.read.schema(FACTS + ", batch bigint").parquet(f"{self.path}/facts")

    def anomalies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/anomalies")

    def closed(self, facts: DataFrame, number: int) -> None:
        """A batch of closed hours, for foreachBatch."""
        facts.write.mode("overwrite").parquet(f"{self.path}/facts/batch={number}")
        own = self.spark.read.schema(FACTS).parquet(f"{self.path}/facts/batch={number}")
        first, last = own.agg(F.min("hour_ts"), F.max("hour_ts")).first()
        if first is None:
            return
        known = self.facts().where((F.col("batch") <= number) & (F.col("hour_ts") <= baselines.at(last)))
        begin = known.agg(F.min("hour_ts")).first()[0] + timedelta(hours=self.cfg.baseline_hours)
        reach = kept(known.where(F.col("hour_ts") >= baselines.at(first) - baselines.hours(24 * REACH)).drop("batch"))
        hours = own.select("hour_ts").distinct()
        long = kept(metrics.metrics_long(metrics.wide_of(metrics.tally(reach))))
        rows = baselines.compare(baselines.rolling_baseline_all_hours(long, self.cfg.baseline_hours, self.cfg.baseline_end, self.cfg.min_samples), self.cfg.iqr_multiplier)
        found = statistical.all_statistical(rows.join(hours, "hour_ts", "left_semi"), None, self.cfg)
        windows = kept(hours.select(F.col("hour_ts").alias("window_start"), (F.col("hour_ts") + baselines.hours(1)).alias("window_end")))
        both = found.unionByName(rules.all_rules(None, windows, self.cfg, reach)).where(F.col("metric_timestamp") >= baselines.at(begin))
        both.write.mode("overwrite").parquet(f"{self.path}/anomalies/batch={number}")

    def start(self, events: DataFrame, checkpoint: str, late: str = "1 hour"):
        """A query over a stream of canonical events that takes what is there and ends; the checkpoint goes on where the last one ended."""
        return hourly_facts(events, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.closed).trigger(availableNow=True).start()
