"""``run_full_detection_pipeline`` as a set-returning SQL routine: every detector over one window, counted, by SQL alone.

It reads the views v_metrics_long, v_hourly_event_counts, v_hour_visitors and dim_event_type, and the thresholds of a DetectionConfig stand in its text. One row: the run's id, what each family found, all of it, and candidate incidents.
"""

from __future__ import annotations

from ..config import DetectionConfig
from ..schema import RATES, REVENUE

NAME = "run_full_detection_pipeline"
# Arguments and columns of the routine.
ARGUMENTS = "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, baseline_periods INT DEFAULT 168"
COLUMNS = "run_id STRING, zscore_anomalies BIGINT, iqr_anomalies BIGINT, rules_anomalies BIGINT, total_anomalies BIGINT, candidate_incidents BIGINT"


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _baselines(cfg: DetectionConfig) -> str:
    """Each metric of the window's hours against its statistics over the periods before the window's end (or begin)."""
    six = lambda x, name: f"CAST(CAST({x} AS DECIMAL(18,6)) AS DOUBLE) AS {name}"
    end = f"{NAME}.{cfg.baseline_end}"
    quarter = lambda p: f"percentile(metric_value, {p})"
    statistics = [six("sum(CAST(round(metric_value * 100) AS BIGINT)) / (count(metric_value) * 100.0D)", "mean"), six("stddev_samp(metric_value)", "std"), six(quarter(0.25), "q1"), six(quarter(0.5), "median"), six(quarter(0.75), "q3"), six(f"{quarter(0.75)} - {quarter(0.25)}", "width")]
    return f"""base AS (SELECT metric_name, {", ".join(statistics)}, count(metric_value) AS samples FROM v_metrics_long
      WHERE hour_ts >= {end} - make_interval(0, 0, 0, 0, {NAME}.baseline_periods) AND hour_ts < {end} GROUP BY metric_name HAVING count(metric_value) >= {cfg.min_samples}),
    tested AS (SELECT l.metric_name, l.hour_ts, metric_value AS v, b.*, CASE WHEN std > 0 THEN (metric_value - mean) / std ELSE 0.0D END AS z, q1 - {cfg.iqr_multiplier}D * width AS low, q3 + {cfg.iqr_multiplier}D * width AS high
      FROM v_metrics_long l JOIN (SELECT metric_name AS metric, * EXCEPT (metric_name) FROM base) b ON l.metric_name = b.metric WHERE hour_ts >= {NAME}.window_start AND hour_ts < {NAME}.window_end)"""


def _statistical(cfg: DetectionConfig) -> str:
    revenue, rates = f"metric_name IN ({_listed(REVENUE)})", f"metric_name IN ({_listed(RATES)})"
    outside = "(v < low OR v > high)"
    tests = [
        ("zscore", f"std > 0 AND abs(z) >= {cfg.z_warning}"), ("zscore", f"std > 0 AND {revenue} AND (z <= -1.5 OR z >= 2.0)"), ("zscore", f"std > 0 AND {rates} AND abs(z) >= {cfg.z_warning}"),
        ("iqr", f"width > 0 AND {outside}"), ("iqr", f"width > 0 AND {revenue} AND (v < q1 - width OR v > q3 + 1.5D * width)"),
        ("iqr", f"width > 0 AND metric_name = 'avg_order_value' AND ((v < 1 AND median > 10) OR v > q3 * 3 OR {outside})"),
    ]
    fired = ", ".join(f"CASE WHEN {when} THEN '{family}' END" for family, when in tests)
    return f"statistical AS (SELECT explode(filter(array({fired}), x -> x IS NOT NULL)) AS detector, metric_name, hour_ts AS at FROM tested)"


def _windows(cfg: DetectionConfig) -> str:
    """What a window holds by type, what is usual by type in the week before, and the usual rate and money of hours."""
    inside, before = (f"hour_ts >= {NAME}.window_start AND hour_ts < {NAME}.window_end", f"hour_ts >= {NAME}.window_start - INTERVAL 7 DAY AND hour_ts < {NAME}.window_start")
    n = lambda kind: f"coalesce(sum(event_count) FILTER (WHERE event_type = '{kind}'), 0)"
    cents = "CAST(round(total_amount * 100) AS BIGINT)"
    own = ", ".join(f"{n(k)} AS {k}" for k in ("add_to_cart", "checkout_start", "checkout_complete", "payment_initiated", "payment_success", "purchase"))
    return f"""counted AS (SELECT {own}, coalesce(sum({cents}) FILTER (WHERE event_type = 'purchase'), 0) AS cents FROM v_hourly_event_counts WHERE {inside}),
    types AS (SELECT d.event_type, coalesce(max(o.n), 0) AS n, max(u.usual) AS usual FROM dim_event_type d LEFT JOIN (SELECT event_type, sum(event_count) AS n FROM v_hourly_event_counts WHERE {inside} GROUP BY 1) o ON o.event_type = d.event_type
      LEFT JOIN (SELECT event_type, avg(event_count) AS usual FROM v_hourly_event_counts WHERE {before} GROUP BY 1) u ON u.event_type = d.event_type GROUP BY 1),
    hours AS (SELECT hour_ts, {n("payment_initiated")} AS tried, {n("payment_success")} AS ok, sum({cents}) FILTER (WHERE event_type = 'purchase') AS cents FROM v_hourly_event_counts WHERE {before} GROUP BY 1),
    usual AS (SELECT avg(CASE WHEN tried > {cfg.gateway_hour_initiated} THEN ok * 100.0D / tried END) AS rate, avg(cents) / 100.0D AS money FROM hours),
    seen AS (SELECT kind, count(DISTINCT id) AS n FROM v_hour_visitors WHERE {inside} GROUP BY 1),
    alike AS (SELECT k.kind, avg(h.n) AS mean FROM (SELECT explode(array('users', 'sessions')) AS kind) k JOIN (SELECT hour_ts, kind, count(id) AS n FROM v_hour_visitors
      WHERE hour_ts IN ({", ".join(f"date_trunc('hour', {NAME}.window_start) - INTERVAL {7 * w} DAY" for w in (1, 2, 3, 4))}) GROUP BY 1, 2) h ON h.kind = k.kind GROUP BY 1)"""


def _rules(cfg: DetectionConfig) -> str:
    at = f"{NAME}.window_start AS at"
    tests = [
        ("'funnel_break_cart'", "checkout_start > 0 AND add_to_cart = 0"), ("'funnel_break_checkout'", "checkout_complete > 0 AND checkout_start = 0"), ("'funnel_break_purchase'", f"payment_success > {cfg.funnel_success} AND purchase = 0"),
        ("'funnel_break_conversion'", f"checkout_complete > {cfg.funnel_complete} AND purchase < checkout_complete * {cfg.funnel_share}D"),
        ("CASE WHEN payment_success = 0 THEN 'payment_gateway_failure' ELSE 'payment_success_rate_drop' END", f"payment_initiated > {cfg.gateway_initiated} AND (payment_success = 0 OR coalesce(payment_success * 100.0D / payment_initiated < rate * {cfg.gateway_warning}D, false))"),
        ("CASE WHEN purchase > 0 AND cents = 0 THEN 'zero_revenue_bug' ELSE 'near_zero_revenue' END", f"(purchase > 0 AND cents = 0) OR coalesce(money > {cfg.revenue_baseline} AND cents / 100.0D < money * {cfg.revenue_share}D, false)"),
    ]
    fired = ", ".join(f"CASE WHEN {when} THEN {metric} END" for metric, when in tests)
    return f"""ruled AS (SELECT 'rules' AS detector, metric_name, {at} FROM (SELECT explode(filter(array({fired}), x -> x IS NOT NULL)) AS metric_name FROM counted CROSS JOIN usual)
      UNION ALL SELECT 'rules', concat(event_type, '_count'), {at} FROM types WHERE n = 0 AND usual > {cfg.missing_baseline}
      UNION ALL SELECT 'rules', concat('unique_', a.kind, '_drop'), {at} FROM alike a LEFT JOIN seen s ON s.kind = a.kind
        WHERE (SELECT mean FROM alike WHERE kind = 'users') > {cfg.traffic_users} AND coalesce(s.n, 0) < a.mean * {1 - cfg.traffic_drop}D)"""


def body(cfg: DetectionConfig = DetectionConfig()) -> str:
    family = lambda x: f"count_if(detector = '{x}')"
    stamp = lambda t: f"date_format({t}, 'yyyyMMddHHmmss')"
    return f"""WITH {_baselines(cfg)},
    {_statistical(cfg)},
    {_windows(cfg)},
    {_rules(cfg)}
    SELECT concat('run-', {stamp(f"{NAME}.window_start")}, '-', {stamp(f"{NAME}.window_end")}, '-', {stamp(f"{NAME}.window_end")}), {family("zscore")}, {family("iqr")}, {family("rules")}, count(*), count(DISTINCT metric_name, at)
    FROM (SELECT * FROM statistical UNION ALL SELECT * FROM ruled)"""
