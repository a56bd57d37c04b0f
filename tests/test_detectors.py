"""Hand-computed cases of thresholds and rules."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from millrace.config import DetectionConfig, RetentionConfig, Window
from millrace.functions import sql_surface
from millrace.operators import baselines, health, lifecycle, metrics, rollup, rules, statistical
from millrace.plans import backtest, pipeline
from millrace.schema import ANOMALIES, BASELINES, DEFAULT_HINT, EVENTS, HINTS, INCIDENTS, RUNS
from millrace.sources.adapter import injected, read_events

from .conftest import DATA

H = datetime(2024, 1, 10, 12)
ROWS = "hour_ts timestamp_ntz, metric_name string, metric_value double, rolling_mean double, rolling_std double, rolling_min double, rolling_max double, percentile_25 double, percentile_50 double, percentile_75 double, iqr double, sample_count bigint"


LOW = DetectionConfig(missing_baseline=0.5, funnel_success=1, funnel_complete=1, gateway_initiated=1, gateway_hour_initiated=0, traffic_users=1, revenue_baseline=10)


def compared(spark, value, metric="page_views", mean=100.0, std=10.0, q1=10.0, median=15.0, q3=20.0, n=24):
    return baselines.compare(spark.createDataFrame([(H, metric, float(value), mean, std, 0.0, 0.0, q1, median, q3, q3 - q1, n)], ROWS))


def told(df):
    return [(r["severity"], r["direction"]) for r in df.collect()]


@pytest.mark.parametrize(("value", "n", "want"), [(120, 24, [("warning", "above")]), (130, 24, [("critical", "above")]), (119.9, 24, []), (80, 24, [("warning", "below")]), (130, 23, [])])
def test_zscore(spark, value, n, want):
    assert told(statistical.zscore(compared(spark, value, n=n))) == want


@pytest.mark.parametrize(("metric", "z", "want"), [("gross_revenue", -1.5, "warning"), ("gross_revenue", -2.5, "critical"), ("revenue_per_session", -1.6, "info"), ("revenue_per_session", -2.5, "warning"), ("gross_revenue", 1.9, None)])
def test_revenue_drops_are_worse(spark, metric, z, want):
    got = told(statistical.zscore_revenue(compared(spark, 100 + 10 * z, metric)))
    assert [s for s, _ in got] == ([want] if want else [])


@pytest.mark.parametrize(("value", "want"), [(-5, []), (-5.1, [("warning", "below")]), (35.1, [("warning", "above")]), (-20.1, [("critical", "below")])])
def test_fences_are_strict(spark, value, want):
    assert told(statistical.iqr(compared(spark, value))) == want


def test_distance_beyond_the_fence(spark):
    assert statistical.iqr(compared(spark, 45)).first()["iqr_distance"] == 1.0


@pytest.mark.parametrize(("value", "want"), [(-0.1, "critical"), (35.1, "warning"), (40.1, "critical")])
def test_revenue_fences(spark, value, want):
    assert statistical.iqr_revenue(compared(spark, value, "gross_revenue")).first()["severity"] == want


@pytest.mark.parametrize("value", [0.5, 180.1])
def test_order_value(spark, value):
    assert statistical.iqr_order_value(compared(spark, value, "avg_order_value", q1=40.0, median=50.0, q3=60.0)).first()["severity"] == "critical"


def test_percentiles_interpolate(spark):
    long = spark.createDataFrame([(H - timedelta(hours=k + 1), "m", v) for k, v in enumerate((1.5, 2.0, 7.25, 9.0))], "hour_ts timestamp_ntz, metric_name string, metric_value double")
    assert baselines.rolling_baseline(long, H, min_samples=1).first()["percentile_25"] == 1.875


def test_an_outlier_in_its_own_baseline(spark):
    long = spark.createDataFrame([(H - timedelta(hours=k + 1), "m", 100.0 if k == 0 else 1.0) for k in range(24)], "hour_ts timestamp_ntz, metric_name string, metric_value double")
    z = baselines.metrics_with_baseline(long, baselines.rolling_baseline(long, H)).agg({"z_score": "max"}).first()[0]
    assert z == pytest.approx(23 / 24**0.5, abs=1e-4)


def test_window_form_equals_self_join(spark):
    long = spark.createDataFrame([(H + timedelta(hours=k), "m", float(k * 7 % 13)) for k in range(24 * 40)], "hour_ts timestamp_ntz, metric_name string, metric_value double")
    assert sorted(map(str, baselines.same_hour_join(long).collect())) == sorted(map(str, baselines.same_hour_window(long).collect()))


def events(spark, *rows):
    """rows: (hours from H, type, how many, amount)."""
    out = []
    for t, kind, n, amount in rows:
        for k in range(n):
            i = len(out)
            out.append((i, H + timedelta(hours=t, seconds=k), f"u{t}-{k}", f"s{t}-{k}", kind, Decimal(amount), "USD", f"o{i}"))
    return spark.createDataFrame(out, EVENTS)


def ruled(df):
    return sorted((r["metric_name"], r["severity"], r["direction"], r["current_value"]) for r in df.collect())


WINDOW = Window(H, H + timedelta(hours=1))


def test_funnel_breaks(spark):
    e = events(spark, (0, "checkout_start", 3, 0), (0, "checkout_complete", 21, 0), (0, "purchase", 10, 5))
    got = ruled(rules.funnel_breaks(e, rules.one_window(e, WINDOW)))
    assert [(m, s) for m, s, *_ in got] == [("funnel_break_cart", "critical"), ("funnel_break_conversion", "warning")]
    assert got[1][3] == pytest.approx(47.619048)


def test_payment_gateway(spark):
    down = events(spark, (0, "payment_initiated", 11, 0))
    assert ruled(rules.payment_gateway(down, rules.one_window(down, WINDOW)))[0][:2] == ("payment_gateway_failure", "critical")
    low = events(spark, (-2, "payment_initiated", 20, 0), (-2, "payment_success", 19, 0), (0, "payment_initiated", 20, 0), (0, "payment_success", 10, 0))
    assert ruled(rules.payment_gateway(low, rules.one_window(low, WINDOW)))[0][:2] == ("payment_success_rate_drop", "warning")


@pytest.mark.parametrize(("users", "want"), [(9, "warning"), (5, "critical"), (10, None)])
def test_traffic_drops(spark, users, want):
    e = events(spark, (-168, "page_view", 20, 0), (-336, "page_view", 20, 0), (0, "page_view", users, 0))
    got = ruled(rules.traffic_drops(e, rules.one_window(e, WINDOW)))
    assert [s for _, s, *_ in got] == ([want, want] if want else [])


def test_zero_revenue(spark):
    e = events(spark, (0, "purchase", 4, 0))
    assert ruled(rules.zero_revenue(e, rules.one_window(e, WINDOW)))[0][0] == "zero_revenue_bug"
    e = events(spark, (-3, "purchase", 1, 1000), (0, "purchase", 1, 99))
    assert ruled(rules.zero_revenue(e, rules.one_window(e, WINDOW)))[0][0] == "near_zero_revenue"


def test_missing_event_types(spark):
    e = events(spark, (-3, "add_to_cart", 6, 0), (-3, "page_view", 5, 0), (0, "purchase", 1, 5))
    assert ruled(rules.missing_event_types(e, rules.one_window(e, WINDOW))) == [("add_to_cart_count", "critical", "missing", 0.0)]


def test_rates_without_denominator_are_zero(spark):
    r = metrics.hourly_metrics(events(spark, (0, "purchase", 1, 36))).first()
    assert r["session_conversion_rate"] == 0 and r["revenue_per_session"] == 0 and r["gross_revenue"] == 36


def test_fused_equals_joined(spark):
    e = events(spark, (0, "page_view", 7, 0), (0, "purchase", 3, 11), (1, "product_view", 2, 0), (1, "add_to_cart", 1, 0))
    a, b = metrics.hourly_metrics(e), metrics.hourly_metrics_joined(e)
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def anomalies(spark, *rows):
    """rows: (metric, severity, direction)."""
    return spark.createDataFrame([("r", H, m, H, 1.0, None, None, None, None, None, None, None, None, "rules", "x", s, d, f"{m} {d}", None) for m, s, d in rows], ANOMALIES)


def test_severity_of_an_incident(spark):
    a = anomalies(spark, ("m", "critical", "above"), ("m", "warning", "above"))
    assert rollup.incidents_of(a).first()["severity"] == "critical"
    assert rollup.incidents_of(a, DetectionConfig(severity_mode="lexicographic")).first()["severity"] == "warning"
    assert rollup.incidents_of(a).first()["related_metrics"] is None


def test_hints(spark):
    by_name = HINTS
    both = anomalies(spark, ("avg_order_value", "warning", "above"), ("gross_revenue", "warning", "above"))
    assert rollup.root_cause_hints(both).first()[1] == by_name["pricing_bug_spike"]
    assert rollup.root_cause_hints(both, True).first()[1] == DEFAULT_HINT
    assert rollup.root_cause_hints(anomalies(spark, ("x", "info", "below"))).first()[1] == DEFAULT_HINT


def test_a_rerun_updates_its_incident(spark):
    new = rollup.incidents_of(anomalies(spark, ("m", "warning", "above")))
    first = rollup.upsert(spark.createDataFrame([], INCIDENTS), new, H)
    assert [r["is_new"] for r in first.collect()] == [True]
    again = rollup.upsert(first.drop("is_new"), rollup.incidents_of(anomalies(spark, ("m", "critical", "above"))), H + timedelta(hours=1)).collect()
    assert [(r["is_new"], r["detection_count"], r["severity"]) for r in again] == [(False, 2, "critical")]


def test_retention_goes_through_runs_and_is_idempotent(spark):
    old, now = datetime(2023, 1, 1), datetime(2024, 1, 1)
    runs = spark.createDataFrame([("r", old, old, old, old, "completed", 168, 18, 1, None)], RUNS)
    a = spark.createDataFrame([("r", now, "m", now, *[None] * 9, "rules", "x", "info", "above", None, None)], ANOMALIES)
    base = spark.createDataFrame([], BASELINES)
    kept, runs_left, base_left, counts = lifecycle.apply_retention(a, runs, base, now, RetentionConfig())
    assert kept.count() == 0 and counts.first().asDict() == {"deleted_anomalies": 1, "deleted_baselines": 0, "deleted_runs": 1}
    assert set(lifecycle.apply_retention(kept, runs_left, base_left, now)[3].first().asDict().values()) == {0}


def test_categories(spark):
    df = spark.createDataFrame([("funnel_break_conversion",), ("funnel_break_cart",), ("add_to_cart_count",), ("gross_revenue",)], "m string")
    assert [r[0] for r in df.select(lifecycle.category(df["m"])).collect()] == ["conversion", "pipeline", "other", "revenue"]


def test_suppression(spark):
    row = lambda key, sent, flag: (key, H, H, "m", "info", 1, 1.0, 1.0, 1.0, None, None, sent, None, flag, "muted" if flag else None, None, None)
    state = spark.createDataFrame([row("a", H - timedelta(hours=1), False), row("b", H - timedelta(hours=5), False), row("c", None, True)], INCIDENTS)
    got = {r["incident_key"]: (r["should_suppress"], r["reason"]) for r in lifecycle.suppression(state.select("incident_key"), state, H).collect()}
    assert got == {"a": (True, "Alert sent 60 minutes ago"), "b": (False, None), "c": (True, "muted")}


def test_evaluation(spark):
    known = spark.createDataFrame([(f"w{k}", H + timedelta(hours=k), H + timedelta(hours=k + 1), ["m"]) for k in range(5)], "anomaly_name string, start_time timestamp_ntz, end_time timestamp_ntz, expected array<string>")
    found = spark.createDataFrame([(H + timedelta(hours=k), "m_x") for k in range(3)] + [(H - timedelta(hours=k + 1), "m") for k in range(7)], "metric_timestamp timestamp_ntz, metric_name string")
    r = backtest.evaluate(found, known)[1].first()
    assert (r["precision"], r["recall"]) == (0.3, 0.6) and r["f1_score"] == pytest.approx(0.4)


def test_health(spark):
    runs = spark.createDataFrame([("r", H, H, H, H, "completed", 168, 18, 1, None)], RUNS)
    assert health.recent_runs(runs, H + timedelta(minutes=31)).first()["status"] == "unhealthy"
    assert health.recent_runs(runs.where("false"), H).first()["status"] == "warning"
    assert health.overall(["healthy", "critical", "unhealthy"]) == "unhealthy"


def test_patterns_are_rows(spark):
    """Wildcards, vacuous and broken patterns, ties, inactive rows; the plan doesn't grow with them."""
    anomalies = spark.createDataFrame([("r", H, m, t, *[None] * 9, "rules", "x", s, d, None, None) for t, m, s, d in ((H, "abXcd_e", "info", "below"), (H, "zz", "critical", "above"), (H + timedelta(hours=1), "abcd", "info", "below"))], ANOMALIES)
    one = lambda name, priority, position, conditions, active=True: (name, priority, name, active, position, conditions)
    rows = [one("two", 5, 1, '[{"metric": "ab_cd", "direction": "below"}, {"metric": "z", "direction": "above", "severity": ["critical"]}]'), one("tie", 5, 2, '[{"metric": "_b", "direction": "below"}]'), one("off", 9, 0, '[{"metric": "a", "direction": "below"}]', False), one("broken", 9, 3, "not JSON"), one("wrong way", 8, 4, '[{"metric": "zz", "direction": "below"}]'), one("graded", 7, 6, '[{"metric": "zz", "direction": "above", "severity": ["warning"]}]')]
    told = lambda rows, **k: {r[0]: r[1] for r in rollup.root_cause_hints(anomalies, patterns=spark.createDataFrame(rows, rollup.PATTERN), **k).collect()}
    later = H + timedelta(hours=1)
    assert told(rows) == {H: "graded", later: "tie"} and told(rows, honour_severity=True) == {H: "two", later: "tie"}
    assert told([]) == {H: DEFAULT_HINT, later: DEFAULT_HINT} and told([*rows, one("always", 6, 7, "[]")]) == {H: "graded", later: "always"}
    size = lambda n: len(rollup.root_cause_hints(anomalies, patterns=spark.createDataFrame([one(f"p{k}", k, k, '[{"metric": "q", "direction": "below"}]') for k in range(n)], rollup.PATTERN))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(2) == size(200)


def test_sliding_statistics_are_those_of_frames(spark):
    rng = random.Random(3)
    rows = [(H + timedelta(hours=h), m, None if rng.random() < 0.02 else round(rng.choice([0.0, 5.0, rng.random() * 100, -3.25]), 2)) for m in ("a", "b") for h in range(0, 400) if rng.random() < 0.8]
    long = spark.createDataFrame(rows, "hour_ts timestamp_ntz, metric_name string, metric_value double")
    key = lambda df: sorted(map(str, df.collect()))
    for periods, end, least, block in ((168, "window_end", 24, None), (30, "window_start", 1, 13), (5, "window_end", 1, 1)):
        got = baselines.rolling_baseline_all_hours(long, periods, end, least, block)
        assert key(got) == key(baselines.rolling_baseline_frames(long, periods, end, least)) and got.count()
    assert baselines.rolling_baseline_all_hours(long.where("false")).count() == 0


def test_windows_of_any_length_meet_what_they_hold(spark):
    rng = random.Random(5)
    points = [(rng.choice(["aa", "bb", "abx"]), H + timedelta(minutes=rng.randrange(60 * 24 * 40))) for _ in range(150)]
    known = []
    for k in range(300):
        start = H + timedelta(minutes=rng.randrange(-60 * 24 * 10, 60 * 24 * 40))
        known.append((f"w{k % 290}", start, start + timedelta(seconds=rng.choice([0, 1, 60, 3599, 3600, 86_400, 86_400 * 33])), rng.choice([["a"], ["bb", "q"], [], ["x"]])))
    frame = spark.createDataFrame(known, "anomaly_name string, start_time timestamp_ntz, end_time timestamp_ntz, expected array<string>")
    detected = spark.createDataFrame(points + points[:20], "metric_name string, metric_timestamp timestamp_ntz")
    per, scored = backtest.evaluate(detected, frame)
    inside = lambda p, w: w[1] <= p[1] < w[2]
    right = lambda p, w: any(e in p[0] for e in w[3])
    every = points + points[:20]
    want = sorted((*w[:3], sum(inside(p, w) and right(p, w) for p in every), sum(inside(p, w) and not right(p, w) for p in every)) for w in known)
    assert sorted(tuple(r)[:5] for r in per.collect()) == sorted(set(want))
    assert scored.first()["false_positives"] == sum(not any(inside(p, w) and right(p, w) for w in known) for p in every)


def test_the_sql_routine_finds_what_runs_find(spark):
    events = injected(read_events(spark, str(DATA / "sf0.001")))
    sql_surface.register(spark, events, datetime(2024, 1, 30), cfg=LOW)
    for start, hours in ((datetime(2024, 1, 20, 10), 4), (datetime(2024, 1, 22), 24), (datetime(2024, 1, 26, 3), 1)):
        window = Window(start, start + timedelta(hours=hours))
        one = spark.sql(f"SELECT * FROM run_full_detection_pipeline(TIMESTAMP_NTZ'{window.start}', TIMESTAMP_NTZ'{window.end}')").first()
        want = pipeline.run(events, window, window.end, cfg=LOW).summary.first()
        assert tuple(one) == tuple(want)
    assert tuple(spark.sql("SELECT * FROM run_full_detection_pipeline(TIMESTAMP_NTZ'2020-01-01 00:00:00', TIMESTAMP_NTZ'2020-01-01 01:00:00')").first())[1:] == (0, 0, 0, 0, 0)
