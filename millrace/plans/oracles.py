"""The registered monitoring queries stated again in SQL: one chain of common table expressions. Names, fixed values and patterns come from the schema, the logic is stated anew."""

from __future__ import annotations

from ..operators.metrics import COUNTS, RATIOS
from ..schema import DEFAULT_HINT, EVENT_TYPES, HINTS, METRICS, PATTERNS, RATES, REVENUE
from .backtest import KNOWN

T = "TIMESTAMP '2024-01-30 00:00:00'"
WEEK = f"hour_ts >= TIMESTAMP '2024-01-23 00:00:00' AND hour_ts < {T}"
DAY = f"hour_ts >= TIMESTAMP '2024-01-29 00:00:00' AND hour_ts < {T}"
names = lambda xs: ", ".join(f"'{x}'" for x in xs)
FILL = "NULL::DOUBLE"


def wide(ev: str) -> str:
    counts = ",\n    ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {n}" for n, k in COUNTS)
    rates = ",\n    ".join(f"CASE WHEN {d} > 0 THEN round({n} * 100.0::DOUBLE / {d}, 2) ELSE 0.0::DOUBLE END AS {r}" for r, n, d in RATIOS)
    per = lambda n: f"CASE WHEN {n} > 0 THEN ((2 * cents + {n}) // (2 * {n})) / 100.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""SELECT hour_ts, {", ".join(n for n, _ in COUNTS)}, unique_users, unique_sessions,
    {rates},
    cents / 100.0::DOUBLE AS gross_revenue, order_count, {per("order_count")} AS avg_order_value, {per("unique_sessions")} AS revenue_per_session
  FROM (SELECT date_trunc('hour', event_time) AS hour_ts,
    {counts},
    count(DISTINCT CASE WHEN event_type = 'page_view' THEN user_id END) AS unique_users,
    count(DISTINCT CASE WHEN event_type = 'page_view' THEN session_id END) AS unique_sessions,
    CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND amount > 0 THEN CAST(amount * 100 AS BIGINT) END), 0) AS BIGINT) AS cents,
    count(DISTINCT CASE WHEN event_type = 'purchase' AND amount > 0 THEN order_id END) AS order_count
    FROM {ev} GROUP BY 1)"""


def long(w: str) -> str:
    return "\n  UNION ALL ".join(f"SELECT hour_ts, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value FROM {w}" for m, *_ in METRICS)


def stats(over: str = "") -> str:
    dec = lambda x: f"CAST(CAST({x} AS DECIMAL(18,6)) AS DOUBLE)"
    q = lambda p: f"quantile_cont(metric_value, {p}){over}"
    mean = f"CAST(sum(CAST(round(metric_value * 100) AS BIGINT)){over} AS BIGINT) / (count(metric_value){over} * 100.0::DOUBLE)"
    return ", ".join([f"{dec(mean)} AS rolling_mean"] + [f"{dec(f'{f}(metric_value){over}')} AS {n}" for n, f in (("rolling_std", "stddev_samp"), ("rolling_min", "min"), ("rolling_max", "max"))] + [f"{dec(q(p / 100))} AS percentile_{p}" for p in (25, 50, 75)] + [f"{dec(f'{q(0.75)} - {q(0.25)}')} AS iqr", f"count(metric_value){over} AS sample_count"])


def baseline(lng: str, t: str) -> str:
    return f"""SELECT metric_name, {t} AS computed_at, 168 AS baseline_periods, {t} - INTERVAL 168 HOUR AS period_start, {t} AS period_end, {stats()}
  FROM {lng} WHERE hour_ts >= {t} - INTERVAL 168 HOUR AND hour_ts < {t} GROUP BY metric_name HAVING count(metric_value) >= 24"""


def compared(rows: str) -> str:
    return f"""SELECT hour_ts, metric_name, metric_value, rolling_mean AS baseline_mean, rolling_std AS baseline_std, percentile_25 AS baseline_q1, percentile_50 AS baseline_median,
    percentile_75 AS baseline_q3, iqr AS baseline_iqr, rolling_min AS baseline_min, rolling_max AS baseline_max, sample_count AS baseline_sample_count,
    CASE WHEN rolling_std > 0 THEN (metric_value - rolling_mean) / rolling_std ELSE 0.0::DOUBLE END AS z_score,
    percentile_25 - 1.5::DOUBLE * iqr AS iqr_lower_bound, percentile_75 + 1.5::DOUBLE * iqr AS iqr_upper_bound,
    CASE WHEN rolling_mean > 0 THEN (metric_value - rolling_mean) / rolling_mean * 100 ELSE 0.0::DOUBLE END AS pct_change_from_mean FROM {rows}"""


def said(text: str, facts: dict[str, str] | None = None) -> str:
    """Further columns: the text, and the facts as a list; numbers are doubles, the others words."""
    one = lambda k, x: f"{{'fact': '{k}', 'number': {FILL if x.startswith('word:') else f'CAST({x} AS DOUBLE)'}, 'word': {x[5:] if x.startswith('word:') else 'NULL::VARCHAR'}}}"
    return f", {text} AS description, [{', '.join(one(k, x) for k, x in (facts or {}).items())}] AS facts" if facts else f", {text} AS description, NULL AS facts"


YES = "word:CASE WHEN {} THEN 'true' ELSE 'false' END".format
MONEY = "CAST(CAST({} AS DECIMAL(24,2)) AS VARCHAR)".format
AGAINST_MEAN = f"metric_name || ' at ' || {MONEY('metric_value')} || ', mean ' || {MONEY('baseline_mean')} || ', z ' || {MONEY('z_score')}"
AGAINST_FENCES = f"metric_name || ' at ' || {MONEY('metric_value')} || ', usually ' || {MONEY('baseline_q1')} || ' to ' || {MONEY('baseline_q3')}"
TOLD = {
    "zscore": said(AGAINST_MEAN),
    "zscore_revenue": said(f"'revenue: ' || {AGAINST_MEAN}", {"metric_category": "word:'revenue'", "impact_severity": "word:'high'", "requires_immediate_action": YES("z_score <= -2.5")}),
    "zscore_conversion": said(f"'conversion: ' || {AGAINST_MEAN}", {"metric_category": "word:'conversion'", "baseline_rate": "baseline_mean", "current_rate": "metric_value"}),
    "iqr": said(AGAINST_FENCES),
    "iqr_revenue": said(f"'revenue: ' || {AGAINST_FENCES}", {"metric_category": "word:'revenue'", "detection_method": "word:'iqr'", "iqr_multiplier_used": "CASE WHEN metric_value < baseline_median THEN 1.0 ELSE 1.5 END"}),
    "aov": said(f"'order value: ' || {AGAINST_FENCES}", {"aov_baseline_median": "baseline_median", "aov_current": "metric_value", "is_zero_aov": YES("metric_value < 1"), "is_extreme_spike": YES("metric_value > baseline_q3 * 3")}),
}


def found(rows: str, where: str, detector: str, rule: str, severity: str, direction: str, distance: str = FILL, told: bool = False) -> str:
    z = "round(z_score, 4)" if detector == "zscore" else FILL
    return f"""SELECT metric_name, hour_ts AS metric_timestamp, metric_value AS current_value, baseline_mean, baseline_std, baseline_q1, baseline_q3, baseline_iqr, {z} AS z_score,
    {distance if distance == FILL else f"round({distance}, 4)"} AS iqr_distance, round(pct_change_from_mean, 4) AS pct_change, '{detector}' AS detector, '{rule}' AS rule, {severity} AS severity, {direction} AS direction{TOLD[rule].replace("z_score", "mwb_i.z_score") if told else ""}
  FROM {rows} WHERE {where}"""


SIGN = "CASE WHEN z_score > 0 THEN 'above' WHEN z_score < 0 THEN 'below' ELSE 'none' END"
MEDIAN = "CASE WHEN metric_value < baseline_median THEN 'below' WHEN metric_value > baseline_median THEN 'above' ELSE 'none' END"
OUT = "(metric_value < iqr_lower_bound OR metric_value > iqr_upper_bound)"
BEYOND = "CASE WHEN metric_value < iqr_lower_bound THEN (iqr_lower_bound - metric_value) / baseline_iqr WHEN metric_value > iqr_upper_bound THEN (metric_value - iqr_upper_bound) / baseline_iqr ELSE 0.0::DOUBLE END"
SEVERE = "CASE WHEN metric_value < baseline_q1 - 3.0::DOUBLE * baseline_iqr OR metric_value > baseline_q3 + 3.0::DOUBLE * baseline_iqr THEN 'critical' ELSE 'warning' END"
FENCE = "CASE WHEN metric_value < iqr_lower_bound THEN 'below' ELSE 'above' END"
SCORED, FENCED = "baseline_std > 0 AND baseline_sample_count >= 24", "baseline_iqr > 0 AND baseline_sample_count >= 24"
Z2 = "CASE WHEN abs(z_score) >= 3 THEN 'critical' ELSE 'warning' END"


def z1(rows, where="true", told=False):
    return found(rows, f"{SCORED} AND {where} AND abs(z_score) >= 2", "zscore", "zscore", Z2, SIGN, told=told)


def z2(rows, where="true", told=False):
    core = f"metric_name IN ({names(m for m in REVENUE if m != 'revenue_per_session')})"
    sev = f"CASE WHEN {core} AND z_score <= -2.5 THEN 'critical' WHEN {core} AND z_score <= -1.5 THEN 'warning' WHEN abs(z_score) >= 3 THEN 'critical' WHEN abs(z_score) >= 2 THEN 'warning' ELSE 'info' END"
    return found(rows, f"{SCORED} AND {where} AND metric_name IN ({names(REVENUE)}) AND (z_score <= -1.5 OR z_score >= 2)", "zscore", "zscore_revenue", sev, SIGN, told=told)


def z3(rows, where="true", told=False):
    return found(rows, f"{SCORED} AND {where} AND metric_name IN ({names(RATES)}) AND abs(z_score) >= 2", "zscore", "zscore_conversion", Z2, SIGN, told=told)


def i1(rows, where="true", told=False):
    return found(rows, f"{FENCED} AND {where} AND {OUT}", "iqr", "iqr", SEVERE, FENCE, BEYOND, told)


def i2(rows, where="true", told=False):
    low = "metric_value < baseline_q1 - 1.0::DOUBLE * baseline_iqr"
    return found(rows, f"{FENCED} AND {where} AND metric_name IN ({names(REVENUE)}) AND ({low} OR metric_value > baseline_q3 + 1.5::DOUBLE * baseline_iqr)", "iqr", "iqr_revenue", f"CASE WHEN {low} OR metric_value > baseline_q3 + 2.0::DOUBLE * baseline_iqr THEN 'critical' ELSE 'warning' END", MEDIAN, "abs(metric_value - baseline_median) / baseline_iqr", told)


def i3(rows, where="true", told=False):
    bad = "(metric_value < 1 AND baseline_median > 10 OR metric_value > baseline_q3 * 3)"
    return found(rows, f"{FENCED} AND {where} AND metric_name = 'avg_order_value' AND ({bad} OR {OUT})", "iqr", "aov", f"CASE WHEN {bad} THEN 'critical' ELSE 'warning' END", MEDIAN, BEYOND, told)


def union(*parts: str) -> str:
    return "\n  UNION ALL ".join(f"({p})" for p in parts)


def all_z(rows, where="true", told=False):
    return union(z1(rows, where, told), z2(rows, where, told), z3(rows, where, told))


def all_i(rows, where="true", told=False):
    return union(i1(rows, where, told), i2(rows, where, told), i3(rows, where, told))


def ruled(metric, value, mean, std, pct, rule, severity, direction, body, told="") -> str:
    return f"""SELECT {metric} AS metric_name, w.window_start AS metric_timestamp, CAST({value} AS DOUBLE) AS current_value, {mean} AS baseline_mean, {std} AS baseline_std, {FILL} AS baseline_q1, {FILL} AS baseline_q3, {FILL} AS baseline_iqr,
    {FILL} AS z_score, {FILL} AS iqr_distance, {pct} AS pct_change, 'rules' AS detector, '{rule}' AS rule, {severity} AS severity, {direction} AS direction{told} {body}"""


def rules(ev: str, w: str, told: bool = False) -> dict[str, str]:
    """Each rule over windows w (window_start, window_end) of events ev, as correlated joins on the raw events. told: with text and facts."""
    say = lambda text, facts: said(text, facts) if told else ""
    dim = ", ".join(f"('{t}', {c})" for t, _, c, _ in EVENT_TYPES)
    inside, hour = "e.event_time >= w.window_start AND e.event_time < w.window_end", "date_trunc('hour', e.event_time)"
    back = lambda days: f"e.event_time >= w.window_start - INTERVAL {days} DAY AND e.event_time < w.window_start"
    n = lambda k: f"count(*) FILTER (WHERE e.event_type = '{k}')"
    sums = f"""SELECT w.window_start, {n("add_to_cart")} AS cart, {n("checkout_start")} AS started, {n("checkout_complete")} AS done, {n("payment_initiated")} AS initiated, {n("payment_success")} AS paid, {n("payment_failed")} AS failed, {n("purchase")} AS bought,
      coalesce(sum(CASE WHEN e.event_type = 'purchase' THEN CAST(e.amount * 100 AS BIGINT) END), 0) / 100.0::DOUBLE AS total, count(DISTINCT e.user_id) AS users, count(DISTINCT e.session_id) AS sessions
      FROM {w} w LEFT JOIN {ev} e ON {inside} GROUP BY 1"""
    missing = ruled("u.event_type || '_count'", 0, "round(u.mean, 4)", FILL, FILL, "missing_event_types", "CASE WHEN d.c THEN 'critical' ELSE 'warning' END", "'missing'", f"""
    FROM (SELECT window_start, event_type, avg(n) AS mean FROM (SELECT w.window_start, e.event_type, {hour} AS h, count(*) AS n FROM {w} w JOIN {ev} e ON {back(7)} GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING avg(n) > 1) u
    JOIN {w} w ON w.window_start = u.window_start JOIN (VALUES {dim}) d(t, c) ON d.t = u.event_type
    WHERE NOT EXISTS (SELECT 1 FROM {ev} e WHERE {inside} AND e.event_type = u.event_type)""",
        say(f"'no ' || u.event_type || ' events, usually ' || {MONEY('u.mean')} || ' an hour'", {"event_type": "word:u.event_type", "is_conversion_event": YES("d.c"), "baseline_avg_count": "round(u.mean, 4)", "window_start": "word:CAST(w.window_start AS VARCHAR)", "window_end": "word:CAST(w.window_end AS VARCHAR)"}))
    counts = "started || ' started, ' || done || ' completed, ' || paid || ' paid, ' || bought || ' bought'"
    check = lambda when, metric, value, severity, direction, **facts: ruled(f"'{metric}'", value, FILL, FILL, FILL, "funnel_breaks", f"'{severity}'", f"'{direction}'", f"FROM ({sums}) w WHERE {when}", say(f"'{metric}: ' || {counts}", facts))
    funnel = union(
        check("started > 0 AND cart = 0", "funnel_break_cart", 0, "critical", "missing", checkout_start="started", add_to_cart="cart"), check("done > 0 AND started = 0", "funnel_break_checkout", 0, "critical", "missing", checkout_complete="done", checkout_start="started"),
        check("paid > 2 AND bought = 0", "funnel_break_purchase", 0, "critical", "missing", payment_success="paid", purchases="bought"), check("done > 2 AND bought < done * 0.5", "funnel_break_conversion", "round(bought * 100.0::DOUBLE / done, 6)", "warning", "below", checkout_complete="done", purchases="bought", conversion_rate="round(bought * 100.0::DOUBLE / done, 6)"),
    )
    gateway = ruled("CASE WHEN paid = 0 THEN 'payment_gateway_failure' ELSE 'payment_success_rate_drop' END", "CASE WHEN paid = 0 THEN 0 ELSE round(paid * 100.0::DOUBLE / initiated, 6) END", "round(mean, 8)", FILL, FILL, "payment_gateway",
        "CASE WHEN paid = 0 OR paid * 100.0::DOUBLE / initiated < mean * 0.5 THEN 'critical' ELSE 'warning' END", "'below'", f"""FROM ({sums}) w LEFT JOIN (
      SELECT window_start, avg(ok * 100.0::DOUBLE / tried) AS mean FROM (SELECT w.window_start, {hour} AS h, {n("payment_success")} AS ok, {n("payment_initiated")} AS tried FROM {w} w JOIN {ev} e ON {back(7)} GROUP BY 1, 2 HAVING {n("payment_initiated")} > 2) GROUP BY 1) b USING (window_start)
    WHERE initiated > 2 AND (paid = 0 OR paid * 100.0::DOUBLE / initiated < mean * 0.7)""".replace("USING (window_start)", "ON b.window_start = w.window_start"),
        say("paid || ' of ' || initiated || ' payments succeeded, ' || failed || ' failed'", {"initiated": "initiated", "success": "paid", "failed": "failed", "current_rate": "round(paid * 100.0::DOUBLE / initiated, 6)", "baseline_rate": "round(mean, 8)"}))
    usual = f"""SELECT window_start, avg(u) AS mu, stddev_samp(u) AS su, avg(s) AS ms, stddev_samp(s) AS ss FROM (SELECT w.window_start, {hour} AS h, count(DISTINCT e.user_id) AS u, count(DISTINCT e.session_id) AS s FROM {w} w
      JOIN {ev} e ON {back(28)} AND dayofweek(e.event_time) = dayofweek(w.window_start) AND hour(e.event_time) = hour(w.window_start) GROUP BY 1, 2) GROUP BY 1 HAVING avg(u) > 2"""
    drop = lambda c, m, s: ruled(f"'unique_{c}_drop'", c, f"round({m}, 4)", f"round({s}, 4)", f"round(({c} - {m}) / {m} * 100, 4)", "traffic_drops", f"CASE WHEN {c} < {m} * 0.3 THEN 'critical' ELSE 'warning' END", "'below'", f"FROM ({sums}) w JOIN ({usual}) b ON b.window_start = w.window_start WHERE {c} < {m} * 0.5", say(f"'only ' || {c} || ' {c}, usually ' || {MONEY(m)}", {"current": c, "baseline_avg": f"round({m}, 4)", "drop_pct": f"-round(({c} - {m}) / {m} * 100, 4)"}))
    money = ruled("CASE WHEN bought > 0 AND total = 0 THEN 'zero_revenue_bug' ELSE 'near_zero_revenue' END", "CASE WHEN bought > 0 AND total = 0 THEN 0 ELSE total END", "round(mean, 4)", FILL, FILL, "zero_revenue", "'critical'", "'below'", f"""FROM ({sums}) w LEFT JOIN (
      SELECT window_start, CAST(sum(m) AS BIGINT) / (count(*) * 100.0::DOUBLE) AS mean FROM (SELECT w.window_start, {hour} AS h, CAST(sum(CAST(e.amount * 100 AS BIGINT)) AS BIGINT) AS m FROM {w} w JOIN {ev} e ON {back(7)} AND e.event_type = 'purchase' GROUP BY 1, 2) GROUP BY 1) b ON b.window_start = w.window_start
    WHERE bought > 0 AND total = 0 OR mean > 10 AND total < mean * 0.1""",
        say(f"bought || ' purchases, revenue ' || {MONEY('total')}", {"purchase_count": "bought", "total_revenue": "total", "baseline_avg": "round(mean, 4)"}))
    return {"missing": missing, "funnel": funnel, "gateway": gateway, "traffic": union(drop("users", "mu", "su"), drop("sessions", "ms", "ss")), "money": money}


def hint(rows: str = "a") -> str:
    """The hint of anomalies of one time, as correlated tests on table anoms."""
    out = []
    for name, _, conditions in sorted(PATTERNS, key=lambda p: -p[1]):
        met = " AND ".join(f"EXISTS (SELECT 1 FROM anoms x WHERE x.metric_timestamp = {rows}.metric_timestamp AND x.metric_name LIKE '{m}%' AND x.direction = '{d}')" for m, d, _ in conditions)
        out.append(f"WHEN {met} THEN '{HINTS[name].replace(chr(39), chr(39) * 2)}'")
    return f"CASE {' '.join(out)} ELSE '{DEFAULT_HINT}' END"


RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
WORST = "CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END"
KEY = "metric_name || '_' || strftime(date_trunc('hour', metric_timestamp), '%Y-%m-%d %H:%M:%S') || '+00'"
CATEGORY = "CASE WHEN metric_name LIKE '%revenue%' OR metric_name LIKE '%order%' OR metric_name LIKE '%aov%' THEN 'revenue' WHEN metric_name LIKE '%rate%' OR metric_name LIKE '%conversion%' THEN 'conversion' WHEN metric_name LIKE '%funnel%' OR metric_name LIKE '%break%' OR metric_name LIKE '%missing%' THEN 'pipeline' ELSE 'other' END"


def incidents(anoms: str, sev: str = WORST) -> str:
    return f"""SELECT {KEY} AS incident_key, metric_name, metric_timestamp, {sev} AS severity, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, count(*) AS detection_count, max(current_value) AS current_value,
    max(baseline_mean) AS baseline_value, max(pct_change) AS deviation_pct,
    (SELECT string_agg(DISTINCT x.metric_name, ',' ORDER BY x.metric_name) FROM {anoms} x WHERE x.metric_timestamp = a.metric_timestamp AND x.metric_name <> a.metric_name) AS related_metrics
  FROM {anoms} a GROUP BY metric_name, metric_timestamp"""


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_known = ", ".join(f"('{n}', {o}, {d}, [{names(e)}])" for n, o, d, e in KNOWN)
R, RI = rules("inj", "day_window"), rules("inj", "hour_windows")
rolling = " OVER (PARTITION BY metric_name ORDER BY epoch(hour_ts) RANGE BETWEEN 601200 PRECEDING AND CURRENT ROW)"
CTES = {
    "ev": f"""SELECT event_id, event_time, user_id, user_id || '-' || strftime(event_time, '%Y%m%d%H') AS session_id, kind AS event_type, CASE WHEN kind = 'purchase' THEN CAST(value AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS amount, CASE WHEN kind = 'purchase' THEN CAST(event_id AS VARCHAR) END AS order_id
  FROM (SELECT event_id, ts AS event_time, CAST(user_id AS VARCHAR) AS user_id, value, CASE WHEN event_type = 'view' AND {_K} < 70 THEN 'page_view' WHEN event_type = 'view' THEN 'product_view' WHEN event_type = 'click' AND {_K} < 45 THEN 'add_to_cart' WHEN event_type = 'click' THEN 'checkout_start'
    WHEN event_type = 'signup' THEN 'payment_initiated' WHEN event_type = 'purchase' AND {_K} < 45 THEN 'purchase' WHEN event_type = 'purchase' THEN 'checkout_complete' WHEN event_type = 'error' AND {_K} < 85 THEN 'payment_success' WHEN event_type = 'error' THEN 'payment_failed' END AS kind FROM events WHERE ts IS NOT NULL) WHERE kind IS NOT NULL""",
    "inj": """SELECT event_id, event_time, user_id, session_id, event_type, CASE WHEN event_type = 'purchase' AND day(event_time) = 22 THEN CAST(0 AS DECIMAL(12,2)) ELSE amount END AS amount, order_id FROM ev
  WHERE NOT (event_type = 'add_to_cart' AND day(event_time) = 20 AND hour(event_time) BETWEEN 10 AND 13) AND NOT (event_type = 'purchase' AND day(event_time) = 21 AND hour(event_time) BETWEEN 3 AND 6)""",
    "wide": wide("ev"), "long": long("wide"), "base": baseline("long", T),
    "history": union(*[baseline("long", f"TIMESTAMP '2024-01-{d:02d} 00:00:00'") for d in (9, 16, 23, 30)]),
    "mwb": compared("(SELECT l.*, b.* EXCLUDE (metric_name) FROM long l LEFT JOIN base b ON b.metric_name = l.metric_name)"),
    "counts": "SELECT date_trunc('hour', event_time) AS hour_ts, event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, CAST(sum(CAST(amount * 100 AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS total_amount, round(CAST(sum(CASE WHEN amount > 0 THEN CAST(amount * 100 AS BIGINT) END) AS BIGINT) / 100.0::DOUBLE / count(CASE WHEN amount > 0 THEN 1 END), 6) AS avg_amount FROM ev GROUP BY 1, 2",
    "hour_windows": "SELECT DISTINCT date_trunc('hour', event_time) AS window_start, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end FROM inj",
    "day_window": f"SELECT {T} - INTERVAL 8 DAY AS window_start, {T} - INTERVAL 7 DAY AS window_end",
    "wide_i": wide("inj"), "long_i": long("wide_i"), "base_i": baseline("long_i", T),
    "mwb_i": compared("(SELECT l.*, b.* EXCLUDE (metric_name) FROM long_i l LEFT JOIN base_i b ON b.metric_name = l.metric_name)"),
    "ruled": union(*RI.values()),
    "anoms": f"SELECT * FROM ({union(all_z('mwb_i', WEEK), all_i('mwb_i', WEEK))}) UNION ALL SELECT * FROM ruled WHERE metric_timestamp >= TIMESTAMP '2024-01-23 00:00:00' AND metric_timestamp < {T}",
    "told": f"SELECT * FROM ({union(all_z('mwb_i', WEEK, True), all_i('mwb_i', WEEK, True))}) UNION ALL SELECT * FROM ({union(*rules('inj', 'hour_windows', True).values())}) WHERE metric_timestamp >= TIMESTAMP '2024-01-23 00:00:00' AND metric_timestamp < {T}",
    "inc": incidents("anoms"),
    "state": f"""SELECT incident_key, metric_timestamp AS first_detected_at, metric_timestamp + INTERVAL 1 HOUR AS last_detected_at, metric_name, severity, detection_count, current_value, baseline_value, deviation_pct, related_metrics,
    CASE WHEN n % 3 = 0 THEN metric_timestamp + INTERVAL 2 HOUR END AS alert_sent_at, n % 5 = 0 AS is_suppressed, CASE WHEN n % 5 = 0 THEN 'muted' END AS suppression_reason, CASE WHEN n % 7 = 0 THEN metric_timestamp + INTERVAL 3 HOUR END AS resolved_at
  FROM (SELECT *, length(metric_name) + hour(metric_timestamp) AS n FROM inc)""",
    "runs": """SELECT strftime(h, '%Y%m%d%H') AS run_id, h + INTERVAL 1 HOUR AS started_at, CASE WHEN n % 6 <> 0 THEN h + INTERVAL 1 HOUR + to_seconds(n * 7) END AS ended_at, CASE WHEN n % 6 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n % 6 <> 0 THEN n % 4 END AS anomalies_detected
  FROM (SELECT h, hour(h) + day(h) AS n FROM (SELECT DISTINCT date_trunc('hour', event_time) AS h FROM ev))""",
    "dated": "SELECT strftime(metric_timestamp, '%Y%m%d%H') AS run_id, metric_timestamp AS detected_at, metric_name, rule, severity FROM anoms",
    "replayed": compared(f"(SELECT hour_ts, metric_name, metric_value, {stats(rolling)} FROM long_i) WHERE sample_count >= 24"),
    "back": f"SELECT * FROM ({union(all_z('replayed'), all_i('replayed'))} UNION ALL SELECT * FROM ruled) WHERE metric_timestamp >= (SELECT date_trunc('hour', min(event_time)) FROM inj) + INTERVAL 168 HOUR",
    "known": f"SELECT name AS anomaly_name, r + to_hours(o) AS start_time, r + to_hours(o + d) AS end_time, e AS expected FROM (VALUES {_known}) k(name, o, d, e), (SELECT date_trunc('hour', max(event_time)) AS r FROM inj)",
    "tested": "SELECT k.anomaly_name, k.start_time, k.end_time, b.metric_name, len(list_filter(k.expected, lambda e: contains(b.metric_name, e))) > 0 AS ok FROM known k LEFT JOIN back b ON b.metric_timestamp >= k.start_time AND b.metric_timestamp < k.end_time",
    "per": "SELECT anomaly_name, start_time, end_time, count(*) FILTER (WHERE ok) AS detected_expected, count(*) FILTER (WHERE metric_name IS NOT NULL AND NOT ok) AS detected_other, count(*) FILTER (WHERE ok) > 0 AS hit FROM tested GROUP BY 1, 2, 3",
}
_PREFIX = "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n  {q})" if n in ("ev", "inj", "anoms", "ruled", "inc") else f"{n} AS (\n  {q})" for n, q in CTES.items())


def sql(body: str) -> str:
    return f"{_PREFIX}\n{body}"


_Z4 = "round(z_score, 4) AS z_score"
_STATE = "incident_key, first_detected_at, last_detected_at, metric_name, severity, detection_count, current_value, baseline_value, deviation_pct, related_metrics, alert_sent_at, is_suppressed"
_NEW = f"({incidents(f'(SELECT * FROM anoms WHERE metric_timestamp >= TIMESTAMP {chr(39)}2024-01-28 00:00:00{chr(39)})')})"
_minutes = lambda c, t: f"(epoch_us({t}) - epoch_us({c})) / 60000000.0::DOUBLE"
_season = "round(same_hour_mean, 6) AS same_hour_mean, round(same_hour_std, 6) AS same_hour_std, sample_count, round(CASE WHEN same_hour_std > 0 THEN (current_value - same_hour_mean) / same_hour_std ELSE 0.0::DOUBLE END, 4) AS same_hour_zscore"
_SEASONAL = f"""SELECT metric_name, current_hour, current_value, {_season} FROM (SELECT a.metric_name, a.hour_ts AS current_hour, a.metric_value AS current_value, avg(b.metric_value) AS same_hour_mean, stddev_samp(b.metric_value) AS same_hour_std, count(b.metric_value) AS sample_count
  FROM long a LEFT JOIN long b ON a.metric_name = b.metric_name AND dayofweek(a.hour_ts) = dayofweek(b.hour_ts) AND hour(a.hour_ts) = hour(b.hour_ts) AND b.hour_ts >= a.hour_ts - INTERVAL 28 DAY AND b.hour_ts < a.hour_ts GROUP BY 1, 2, 3) WHERE sample_count >= 2"""
_TOLD = "count(*) FILTER (WHERE detector = 'zscore') AS zscore_anomalies, count(*) FILTER (WHERE detector = 'iqr') AS iqr_anomalies, count(*) FILTER (WHERE detector = 'rules') AS rules_anomalies, count(*) AS total_anomalies, count(DISTINCT (metric_name, metric_timestamp)) AS candidate_incidents"
_FOUND = f"{union(all_z('mwb', WEEK), all_i('mwb', WEEK), *rules('ev', 'week_window').values())}"
# Expected of the table of patterns, stated by hand beside the built-in ones: (position, priority, hint, conditions of prefix and direction).
_MORE = [(100, 200, "A step of the funnel lacks the one before.", [("funnel_break", "missing")]), (102, 150, "Revenue of any kind is low.", [("_ero_rev", "below"), ("gross", "below")])]
_ALL = [(k, p, HINTS[n], [(m, d) for m, d, _ in c]) for k, (n, p, c) in enumerate(PATTERNS) if n != "payment_gateway_down"] + _MORE
_lit = lambda x: "'" + x.replace("'", "''") + "'"
_PATTERNS = f"""SELECT a.metric_timestamp, coalesce((SELECT p.hint FROM (VALUES {", ".join(f"({k}, {p}, {_lit(h)})" for k, p, h, _ in _ALL)}) p(position, priority, hint)
    WHERE NOT EXISTS (SELECT 1 FROM (VALUES {", ".join(f"({k}, '{m}', '{d}')" for k, _, _, c in _ALL for m, d in c)}) c(position, prefix, direction) WHERE c.position = p.position
      AND NOT EXISTS (SELECT 1 FROM anoms x WHERE x.metric_timestamp = a.metric_timestamp AND x.direction = c.direction AND x.metric_name LIKE c.prefix || '%'))
    ORDER BY p.priority DESC, p.position LIMIT 1), {_lit(DEFAULT_HINT)}) AS root_cause_hint FROM (SELECT DISTINCT metric_timestamp FROM anoms) a"""
_BODIES = {
    "q_pattern_table": _PATTERNS,
    "q_anomaly_texts": "SELECT metric_name, metric_timestamp, rule, description FROM told",
    "q_anomaly_facts": "SELECT metric_name, metric_timestamp, rule, f.fact AS fact, round(f.number, 4) AS number, f.word AS word FROM (SELECT metric_name, metric_timestamp, rule, unnest(facts) AS f FROM told WHERE facts IS NOT NULL) WHERE f.number IS NOT NULL OR f.word IS NOT NULL",
    "q_incident_texts": f"SELECT incident_key, combined_description, {hint('i')} AS root_cause_hint FROM (SELECT {KEY} AS incident_key, metric_timestamp, string_agg(DISTINCT description, ' | ' ORDER BY description) AS combined_description FROM told GROUP BY metric_name, metric_timestamp) i",
    "q_run_log": f"SELECT {T} AS started_at, {T} + INTERVAL 90 SECOND AS ended_at, {T} - INTERVAL 7 DAY AS window_start, {T} AS window_end, 'completed' AS status, 168 AS baseline_periods, 18 AS metrics_computed, CAST(count(*) AS INTEGER) AS anomalies_detected, CAST(NULL AS VARCHAR) AS error_message FROM ({union(all_z('mwb', WEEK), all_i('mwb', WEEK), *rules('ev', 'week_window').values())}) UNION ALL SELECT {T}, {T} + INTERVAL 5 SECOND, {T} - INTERVAL 7 DAY, {T}, 'failed', 168, NULL, NULL, 'no events'",
    "q_unpaid_orders": "SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS amount, o_orderstatus AS status FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) = 0",
    "q_event_distribution": "SELECT event_type, count(*) AS cnt FROM ev GROUP BY 1",
    "q_data_range": "SELECT min(event_time) AS first_event, max(event_time) AS last_event, count(*) AS events FROM ev",
    "q_hourly_event_counts": "SELECT * FROM counts",
    "q_hourly_funnel": f"SELECT hour_ts, {', '.join(n for n, _ in COUNTS)}, unique_users, unique_sessions FROM wide",
    "q_conversion_rates": f"SELECT hour_ts, {', '.join(r for r, *_ in RATIOS)} FROM wide",
    "q_hourly_revenue": "SELECT hour_ts, cents / 100.0::DOUBLE AS gross_revenue, n AS order_count, ((2 * cents + n) // (2 * n)) / 100.0::DOUBLE AS avg_order_value, purchasing_sessions FROM (SELECT date_trunc('hour', event_time) AS hour_ts, CAST(sum(CAST(amount * 100 AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT order_id) AS n, count(DISTINCT session_id) AS purchasing_sessions FROM ev WHERE event_type = 'purchase' AND amount > 0 GROUP BY 1)",
    "q_revenue_per_session": "SELECT hour_ts, gross_revenue, order_count, avg_order_value, unique_sessions, revenue_per_session FROM wide",
    "q_hourly_metrics_wide": "SELECT * FROM wide",
    "q_hourly_metrics_joined": "SELECT * FROM wide",
    "q_metrics_long": "SELECT * FROM long",
    "q_rolling_baseline": "SELECT * FROM base",
    "q_rolling_baseline_all_hours": f"SELECT * FROM (SELECT hour_ts, metric_name, metric_value, {stats(rolling)} FROM long) WHERE sample_count >= 24",
    "q_current_baseline": "SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY computed_at DESC) = 1",
    "q_baseline_asof": "SELECT l.metric_name, l.hour_ts AS asked_at, h.computed_at, rolling_mean, rolling_std, percentile_25, percentile_75, iqr, sample_count FROM long l JOIN history h ON h.metric_name = l.metric_name AND h.computed_at <= l.hour_ts QUALIFY row_number() OVER (PARTITION BY l.metric_name, l.hour_ts ORDER BY h.computed_at DESC) = 1",
    "q_metrics_with_baseline": "SELECT * REPLACE (round(z_score, 4) AS z_score, round(pct_change_from_mean, 4) AS pct_change_from_mean, round(iqr_lower_bound, 4) AS iqr_lower_bound, round(iqr_upper_bound, 4) AS iqr_upper_bound) FROM mwb",
    "q_metrics_snapshot": f"SELECT hour_ts, metric_name, metric_value, baseline_mean, {_Z4}, round(pct_change_from_mean, 4) AS pct_change_from_mean, baseline_sample_count FROM mwb WHERE {DAY}",
    "q_same_hour_baseline_join": _SEASONAL,
    "q_same_hour_baseline_window": _SEASONAL,
    "q_zscore_view": f"SELECT hour_ts, metric_name, metric_value, baseline_mean, baseline_std, {_Z4}, round(pct_change_from_mean, 4) AS pct_change_from_mean, CASE WHEN abs(z_score) >= 3 THEN 'critical' WHEN abs(z_score) >= 2 THEN 'warning' ELSE 'info' END AS severity, {SIGN.replace('z_score', 'mwb.z_score')} AS direction, baseline_sample_count FROM mwb WHERE {SCORED} AND abs(mwb.z_score) >= 1.5".replace("abs(z_score)", "abs(mwb.z_score)"),
    "q_zscore_detect": z1("mwb", WEEK),
    "q_zscore_revenue": z2("mwb", WEEK),
    "q_zscore_conversion": z3("mwb", WEEK),
    "q_zscore_all": all_z("mwb", WEEK),
    "q_iqr_view": f"SELECT hour_ts, metric_name, metric_value, baseline_q1, baseline_median, baseline_q3, baseline_iqr, round(mwb.iqr_lower_bound, 4) AS iqr_lower_bound, round(mwb.iqr_upper_bound, 4) AS iqr_upper_bound, round({BEYOND.replace('iqr_', 'mwb.iqr_').replace('baseline_mwb.iqr_', 'baseline_iqr')}, 4) AS iqr_distance, {SEVERE} AS severity, {FENCE.replace('iqr_', 'mwb.iqr_')} AS direction, baseline_sample_count FROM mwb WHERE {FENCED} AND {OUT.replace('iqr_', 'mwb.iqr_')}",
    "q_iqr_detect": i1("mwb", WEEK),
    "q_iqr_revenue": i2("mwb", WEEK),
    "q_aov_detect": i3("mwb", WEEK),
    "q_iqr_all": all_i("mwb", WEEK),
    "q_missing_event_types": RI["missing"],
    "q_funnel_breaks": RI["funnel"],
    "q_payment_gateway": RI["gateway"],
    "q_traffic_drops": RI["traffic"],
    "q_zero_revenue": RI["money"],
    "q_rules_all": "SELECT * FROM ruled",
    "q_rules_day_window": union(*R.values()),
    "q_anomalies_all": "SELECT * FROM anoms",
    "q_run_summary": f"SELECT {_TOLD} FROM ({_FOUND})",
    "q_group_members": f"SELECT category, incident_key, metric_name, severity, first_value(incident_key) OVER (PARTITION BY category ORDER BY o) AS primary_key, incident_key = first_value(incident_key) OVER (PARTITION BY category ORDER BY o) AS is_primary FROM (SELECT *, {CATEGORY} AS category, row_number() OVER (ORDER BY {RANK}, last_detected_at DESC, incident_key) AS o FROM state)",
    "q_anomaly_ids": "SELECT sha256(concat_ws('~', 'week', detector, rule, metric_name, strftime(metric_timestamp, '%Y-%m-%d %H:%M:%S'))) AS anomaly_id, metric_name, metric_timestamp, rule FROM anoms",
    "q_injected_unpaid_orders": "SELECT o_orderkey AS order_id, 0.0::DOUBLE AS amount, o_orderstatus AS status FROM orders WHERE o_orderkey % 97 = 0 OR CAST(o_totalprice AS DECIMAL(12,2)) = 0",
    "q_sql_pipeline": f"SELECT {_TOLD} FROM ({_FOUND})",
    "q_rerun": f"SELECT {_TOLD}, count(DISTINCT (metric_name, metric_timestamp)) AS incidents, count(*) AS detections, CAST(1 AS BIGINT) AS runs FROM ({_FOUND})",
    "q_stored_event_counts": "SELECT * FROM counts",
    "q_stored_metrics_wide": "SELECT * FROM wide",
    "q_stored_rules": "SELECT * FROM ruled",
    "q_weekly_visitors": """SELECT date_trunc('week', event_time)::TIMESTAMP AS week, event_type, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions,
  count(DISTINCT CASE WHEN event_type = 'purchase' AND amount > 0 THEN order_id END) AS orders, count(DISTINCT CASE WHEN event_type = 'purchase' AND amount > 0 THEN session_id END) AS buyers FROM ev GROUP BY 1, 2""",
    "q_topk_anomalies": "SELECT metric_name, metric_timestamp, rule, severity, z_score FROM anoms WHERE z_score IS NOT NULL ORDER BY abs(z_score) DESC, metric_name, metric_timestamp, rule LIMIT 20",
    "q_incident_rollup": "SELECT * FROM inc",
    "q_incident_severity_lexicographic": f"SELECT {KEY} AS incident_key, max(severity) AS severity FROM anoms GROUP BY metric_name, metric_timestamp",
    "q_related_metrics": "SELECT metric_name, metric_timestamp, related_metrics FROM inc",
    "q_root_cause_hint": f"SELECT metric_timestamp, {hint('a')} AS root_cause_hint FROM (SELECT DISTINCT metric_timestamp FROM anoms) a",
    "q_incident_upsert": f"""SELECT coalesce(s.incident_key, n.incident_key) AS incident_key, CASE WHEN s.incident_key IS NULL THEN {T} ELSE s.first_detected_at END AS first_detected_at, CASE WHEN n.incident_key IS NULL THEN s.last_detected_at ELSE {T} END AS last_detected_at, coalesce(s.metric_name, n.metric_name) AS metric_name,
    CASE WHEN n.incident_key IS NULL THEN s.severity WHEN s.incident_key IS NULL THEN n.severity WHEN n.severity = 'critical' OR s.severity = 'critical' THEN 'critical' ELSE n.severity END AS severity, CASE WHEN n.incident_key IS NULL THEN s.detection_count WHEN s.incident_key IS NULL THEN n.detection_count ELSE s.detection_count + 1 END AS detection_count,
    CASE WHEN n.incident_key IS NULL THEN s.current_value ELSE n.current_value END AS current_value, CASE WHEN s.incident_key IS NULL THEN n.baseline_value ELSE s.baseline_value END AS baseline_value, CASE WHEN n.incident_key IS NULL THEN s.deviation_pct ELSE n.deviation_pct END AS deviation_pct,
    CASE WHEN n.incident_key IS NULL THEN s.related_metrics ELSE coalesce(n.related_metrics, s.related_metrics) END AS related_metrics, s.alert_sent_at, CAST(NULL AS VARCHAR) AS alert_channel, CASE WHEN s.incident_key IS NULL THEN false ELSE s.is_suppressed END AS is_suppressed, s.suppression_reason, s.resolved_at, CAST(NULL AS VARCHAR) AS resolution_notes, s.incident_key IS NULL AS is_new
  FROM state s FULL JOIN {_NEW} n ON n.incident_key = s.incident_key AND s.resolved_at IS NULL AND s.last_detected_at >= {T} - INTERVAL 24 HOUR""",
    "q_active_incidents": f"SELECT {_STATE}, round((epoch_us({T}) - epoch_us(first_detected_at)) / 3600000000.0::DOUBLE, 6) AS hours_active, round({_minutes('last_detected_at', T)}, 6) AS minutes_since_last FROM state WHERE resolved_at IS NULL AND NOT is_suppressed",
    "q_incident_summary": f"SELECT severity, count(*) AS incident_count, count(*) FILTER (WHERE alert_sent_at IS NULL) AS pending_alerts, count(*) FILTER (WHERE resolved_at IS NOT NULL) AS resolved_count, min(first_detected_at) AS earliest_detection, max(last_detected_at) AS latest_detection FROM state WHERE last_detected_at >= {T} - INTERVAL 24 HOUR GROUP BY 1",
    "q_resolve_stale": f"SELECT incident_key, CASE WHEN resolved_at IS NULL AND last_detected_at < {T} - INTERVAL 24 HOUR THEN {T} ELSE resolved_at END AS resolved_at FROM state",
    "q_cleanup_anomalies": f"SELECT * FROM dated WHERE detected_at >= {T} - INTERVAL 3 DAY",
    "q_retention": f"SELECT (SELECT count(*) FROM dated d WHERE d.detected_at < {T} - INTERVAL 3 DAY OR EXISTS (SELECT 1 FROM runs r WHERE r.run_id = d.run_id AND r.started_at < {T} - INTERVAL 5 DAY)) AS deleted_anomalies, (SELECT count(*) FROM history WHERE period_end < {T} - INTERVAL 10 DAY) AS deleted_baselines, (SELECT count(*) FROM runs WHERE started_at < {T} - INTERVAL 5 DAY) AS deleted_runs",
    "q_suppression": f"""SELECT s.incident_key, coalesce(o.is_suppressed, false) OR coalesce({_minutes('o.alert_sent_at', "TIMESTAMP '2024-01-28 00:00:00'")} < 240, false) AS should_suppress,
    CASE WHEN o.is_suppressed THEN o.suppression_reason WHEN {_minutes('o.alert_sent_at', "TIMESTAMP '2024-01-28 00:00:00'")} < 240 THEN 'Alert sent ' || CAST(CAST(round({_minutes('o.alert_sent_at', "TIMESTAMP '2024-01-28 00:00:00'")}, 0) AS BIGINT) AS VARCHAR) || ' minutes ago' END AS reason FROM state s LEFT JOIN state o ON o.incident_key = s.incident_key AND o.resolved_at IS NULL""",
    "q_suppression_stats": f"SELECT count(*) FILTER (WHERE is_suppressed) AS suppressed_count, count(*) FILTER (WHERE NOT is_suppressed AND resolved_at IS NULL) AS active_count, count(*) FILTER (WHERE resolved_at IS NOT NULL) AS resolved_count, count(*) FILTER (WHERE alert_sent_at IS NOT NULL) AS alerted_count FROM state WHERE last_detected_at >= {T} - INTERVAL 24 HOUR",
    "q_group_incidents": f"SELECT category, arg_min(incident_key, o) AS incident_key, arg_min(metric_name, o) AS metric_name, {WORST} AS severity, count(*) - 1 AS related_count, string_agg(metric_name, ',' ORDER BY o) AS grouped_metrics FROM (SELECT *, {CATEGORY} AS category, row_number() OVER (ORDER BY {RANK}, last_detected_at DESC, incident_key) AS o FROM state) GROUP BY 1",
    "q_backtest_windows": "SELECT * FROM back",
    "q_backtest_matches": "SELECT * FROM per",
    "q_backtest_eval": """SELECT tp AS true_positives, fn AS false_negatives, fp AS false_positives, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 6) AS f1_score FROM (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0::DOUBLE END AS r FROM (
    SELECT (SELECT count(*) FROM per WHERE hit) AS tp, (SELECT count(*) FROM per WHERE NOT hit) AS fn, (SELECT count(*) FROM back b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE b.metric_timestamp >= k.start_time AND b.metric_timestamp < k.end_time AND len(list_filter(k.expected, lambda e: contains(b.metric_name, e))) > 0)) AS fp))""",
    "q_health_freshness": f"SELECT latest_event, round({_minutes('latest_event', T)}, 4) AS minutes_ago, events_last_hour, CASE WHEN latest_event IS NULL OR round({_minutes('latest_event', T)}, 4) > 30 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT max(event_time) AS latest_event, count(*) AS events_last_hour FROM ev WHERE event_time >= {T} - INTERVAL 1 HOUR AND event_time <= {T})",
    "q_health_runs": f"SELECT run_id, last_ended_at, round({_minutes('last_ended_at', T)}, 4) AS minutes_ago, failed_count, CASE WHEN last_ended_at IS NULL THEN 'warning' WHEN round({_minutes('last_ended_at', T)}, 4) > 30 THEN 'unhealthy' ELSE 'healthy' END AS status FROM (SELECT arg_max(run_id, ended_at) AS run_id, max(ended_at) AS last_ended_at, count(*) FILTER (WHERE status = 'failed' AND started_at >= {T} - INTERVAL 1 HOUR) AS failed_count FROM runs)",
    "q_incident_queue": "SELECT critical_count, warning_count, pending_alerts, total_active, CASE WHEN critical_count > 0 THEN 'critical' WHEN warning_count > 0 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE alert_sent_at IS NULL) AS pending_alerts, count(*) AS total_active FROM state WHERE resolved_at IS NULL)",
    "q_run_stats": f"SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(coalesce(avg((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0::DOUBLE), 0), 4) AS avg_duration_seconds, CAST(coalesce(sum(anomalies_detected), 0) AS BIGINT) AS total_anomalies, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*), 4) ELSE 0.0::DOUBLE END AS success_rate FROM runs WHERE started_at >= {T} - INTERVAL 24 HOUR",
    "q_insert_if_absent": f"SELECT t AS event_type, CAST(o AS BIGINT) AS n FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {o})' for t, _, _, o in EVENT_TYPES if o <= 4)}) d(t, o) UNION ALL SELECT event_type, count(*) FROM ev WHERE event_type NOT IN ({names(t for t, _, _, o in EVENT_TYPES if o <= 4)}) GROUP BY 1",
    "q_zero_amount_orders": "SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS amount, o_orderstatus AS status FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) < 5000",
}
_PREFIX += f",\nweek_window AS (SELECT {T} - INTERVAL 7 DAY AS window_start, {T} AS window_end)"
ORACLES: dict[str, str] = {name: sql(body) for name, body in _BODIES.items()}
