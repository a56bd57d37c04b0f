"""Hourly aggregates kept up to date: late events, merged distinct counts, what is read, what a crash leaves."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.config import DetectionConfig, Window
from millrace.operators import metrics, partials, rules
from millrace.plans import pipeline, stored
from millrace.sources import synthetic
from millrace.sources.tables import kept

END = datetime(2024, 3, 31)
CFG = DetectionConfig(traffic_users=1, missing_baseline=0.5, funnel_success=1, gateway_initiated=1)


@pytest.fixture(scope="module")
def events(spark):
    return kept(synthetic.generate(spark, END, days=9, sessions=20))


@pytest.fixture(scope="module")
def store(spark, events, tmp_path_factory):
    """Most events first, then some that are late, of two days."""
    s = stored.Hourly(spark, str(tmp_path_factory.mktemp("hourly") / "h"))
    late = (F.col("event_id") % 5 == 0) & F.to_date("event_time").isin(datetime(2024, 3, 24).date(), datetime(2024, 3, 27).date())
    s.arrive(events.where(~late))
    assert len(s.refresh()) == 9 and s.refresh() == []
    s.arrive(events.where(late))
    assert [str(d) for d in s.days(s.dirty())] and [str(d) for d in s.refresh()] == ["2024-03-24", "2024-03-27"]
    return s


def key(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_late_events_end_as_a_full_computation(store, events):
    assert key(store.wide()) == key(metrics.hourly_metrics(events))
    assert key(metrics.counts_of(store.tally())) == key(metrics.event_counts(events))
    assert key(partials.all_rules(store.sums(), store.marks(), cfg=CFG)) == key(rules.all_rules(events, cfg=CFG))


def test_distinct_counts_merge(store, events):
    by = store.marks().withColumn("span", F.when(F.hour("hour_ts") < 7, "night").otherwise("day"))
    got = partials.across(by, "span")
    span, paid = F.when(F.hour("event_time") < 7, "night").otherwise("day"), (F.col("event_type") == "purchase") & (F.col("amount") > 0)
    want = events.groupBy(span.alias("span")).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(paid, F.col("order_id"))).alias("orders"), F.countDistinct(F.when(paid, F.col("session_id"))).alias("buyers"))
    assert key(got) == key(want)


def test_ids_are_numbered_once_and_closely(store, events):
    ids = store.ids()
    for kind, column in (("user", "user_id"), ("session", "session_id")):
        own = ids.where(F.col("kind") == kind)
        n = own.count()
        assert n == own.select("id").distinct().count() == events.select(column).distinct().count() and sorted(r["n"] for r in own.collect()) == list(range(1, n + 1))


def test_a_run_from_the_store_reads_no_event(spark, store, events, tmp_path):
    window = Window(datetime(2024, 3, 30, 18), datetime(2024, 3, 30, 19))
    base, found = store.detected(window, CFG)
    want_base, want = pipeline.detect(events, window, CFG)
    assert key(base) == key(want_base) and key(found) == key(want) and want.count() > 0
    sums, marks = store.between(window.start - timedelta(days=2), window.end)
    files = {f.split("/")[-2] for f in sums.inputFiles()} if sums.inputFiles() else set()
    assert not any("/events/" in f for df in (sums, marks) for f in df.inputFiles()) and files
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_only_changed_days_are_read(spark, store, monkeypatch):
    """The scan of a refresh names its days as partition filters, and its rows are theirs."""
    store.arrive(store.events().drop("day").where("date(event_time) = DATE'2024-03-25'").limit(3))
    seen = []
    plain = metrics.facts
    monkeypatch.setattr(metrics, "facts", lambda df: seen.append(df) or plain(df))
    before = store.events().where("day = DATE'2024-03-25'").count()
    assert [str(d) for d in store.refresh()] == ["2024-03-25"]
    assert seen[0].count() == before and "PartitionFilters: [isnotnull(day" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert store.sums().where("day = DATE'2024-03-25'").agg(F.sum("n")).first()[0] == before


@pytest.mark.parametrize("dies", ["numbered", "marks", "sums"])
def test_a_refresh_that_dies_is_made_good_by_the_next(spark, events, tmp_path, monkeypatch, dies):
    s = stored.Hourly(spark, str(tmp_path / "h"))
    few = kept(events.where("day(event_time) in (25, 26)"))
    s.arrive(few)
    with monkeypatch.context() as m:
        m.setattr(partials, dies, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            s.refresh()
    assert len(s.refresh()) == 2 and key(s.wide()) == key(metrics.hourly_metrics(few)) and s.dirty() == []


def test_no_distinct_count_expands_events(events):
    plan = metrics.hourly_metrics_joined(events)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_empty_store(spark, tmp_path):
    s = stored.Hourly(spark, str(tmp_path / "h"))
    assert s.refresh() == [] and s.wide().count() == 0
    s.arrive(synthetic.generate(spark, END, days=1, sessions=1).where("false"))
    assert s.refresh() == [] and s.dirty() == [] and partials.all_rules(s.sums(), s.marks()).count() == 0
