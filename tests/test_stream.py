"""The stream finds what a replay finds, after restarts and batches that run twice."""

from pyspark.sql import functions as F

from millrace.config import DetectionConfig
from millrace.operators import metrics
from millrace.plans import backtest
from millrace.schema import EVENTS
from millrace.sources.adapter import injected, read_events
from millrace.sources.tables import kept
from millrace.streaming.monitor import Monitor

from .conftest import DATA

CFG = DetectionConfig(missing_baseline=1, funnel_success=2, funnel_complete=2, gateway_initiated=2, gateway_hour_initiated=2, traffic_users=2, revenue_baseline=10)


def key(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_stream_finds_what_a_replay_finds(spark, tmp_path):
    events = injected(read_events(spark, str(DATA / "sf0.01"))).where("event_time < TIMESTAMP_NTZ'2024-01-24'").cache()
    parts = ["event_time < TIMESTAMP_NTZ'2024-01-10 07:20:00'", "event_time >= TIMESTAMP_NTZ'2024-01-10 07:20:00' AND event_time < TIMESTAMP_NTZ'2024-01-18'", "event_time >= TIMESTAMP_NTZ'2024-01-18'"]
    source, monitor = str(tmp_path / "in"), Monitor(spark, str(tmp_path / "out"), CFG)

    def run():
        query = monitor.start(spark.readStream.schema(EVENTS).parquet(source), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None

    for part in parts[:2]:
        events.where(part).select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(source)
    run()
    middle = monitor.anomalies().count()
    events.where(parts[2]).select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(source)
    run()  # another query, from the checkpoint
    last = monitor.facts().agg(F.max("hour_ts")).first()[0]
    facts = metrics.facts(events).where(F.col("hour_ts") <= F.lit(last))
    assert key(monitor.facts().drop("batch")) == key(facts)
    want = backtest.replay(events, CFG).where(F.col("metric_timestamp") <= F.lit(last))
    assert key(monitor.anomalies().drop("batch")) == key(want) and 0 < middle < want.count()
    number = monitor.facts().agg(F.max("batch")).first()[0]
    before = key(monitor.anomalies())
    monitor.closed(kept(monitor.facts().where(F.col("batch") == number).drop("batch")), number)  # as after a crash before the batch was committed
    assert key(monitor.anomalies()) == before
    events.unpersist()
