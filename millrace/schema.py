"""Schemas of facts and state tables, and the fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, event_time timestamp_ntz, user_id string, session_id string, event_type string, amount decimal(12,2), currency string, order_id string"
RUNS = "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz, window_start timestamp_ntz, window_end timestamp_ntz, status string, baseline_periods int, metrics_computed int, anomalies_detected int, error_message string"
BASELINES = "metric_name string, computed_at timestamp_ntz, baseline_periods int, period_start timestamp_ntz, period_end timestamp_ntz, rolling_mean double, rolling_std double, rolling_min double, rolling_max double, percentile_25 double, percentile_50 double, percentile_75 double, iqr double, sample_count bigint"
ANOMALIES = "run_id string, detected_at timestamp_ntz, metric_name string, metric_timestamp timestamp_ntz, current_value double, baseline_mean double, baseline_std double, baseline_q1 double, baseline_q3 double, baseline_iqr double, z_score double, iqr_distance double, pct_change double, detector string, rule string, severity string, direction string, description string, metadata_json string"
INCIDENTS = "incident_key string, first_detected_at timestamp_ntz, last_detected_at timestamp_ntz, metric_name string, severity string, detection_count bigint, current_value double, baseline_value double, deviation_pct double, root_cause_hint string, related_metrics array<string>, alert_sent_at timestamp_ntz, alert_channel string, is_suppressed boolean, suppression_reason string, resolved_at timestamp_ntz, resolution_notes string"

# Event types as (type, category, is a conversion event, place in the funnel).
EVENT_TYPES = [
    ("page_view", "engagement", False, 1),
    ("product_view", "engagement", False, 2),
    ("add_to_cart", "cart", True, 3),
    ("remove_from_cart", "cart", False, 0),
    ("checkout_start", "checkout", True, 4),
    ("checkout_complete", "checkout", True, 5),
    ("payment_initiated", "payment", True, 6),
    ("payment_success", "payment", True, 7),
    ("payment_failed", "payment", False, 0),
    ("purchase", "conversion", True, 8),
    ("refund", "post_purchase", False, 0),
]
# Currencies and their US dollar rates.
CURRENCIES = [("USD", "US Dollar", "1.000000"), ("EUR", "Euro", "1.080000"), ("GBP", "British Pound", "1.260000"), ("JPY", "Japanese Yen", "0.006700"), ("CAD", "Canadian Dollar", "0.740000")]
# Metrics of the long table as (name, category, unit, higher is better).
METRICS = [
    ("page_views", "funnel", "count", True),
    ("product_views", "funnel", "count", True),
    ("add_to_cart", "funnel", "count", True),
    ("checkout_start", "funnel", "count", True),
    ("checkout_complete", "funnel", "count", True),
    ("purchases", "funnel", "count", True),
    ("unique_users", "engagement", "count", True),
    ("unique_sessions", "engagement", "count", True),
    ("payment_success", "payment", "count", True),
    ("payment_failed", "payment", "count", False),
    ("checkout_completion_rate", "conversion", "percent", True),
    ("checkout_to_purchase_rate", "conversion", "percent", True),
    ("session_conversion_rate", "conversion", "percent", True),
    ("payment_success_rate", "conversion", "percent", True),
    ("gross_revenue", "revenue", "usd", True),
    ("order_count", "revenue", "count", True),
    ("avg_order_value", "revenue", "usd", True),
    ("revenue_per_session", "revenue", "usd", True),
]
REVENUE = [m for m, category, *_ in METRICS if category == "revenue"]
RATES = [m for m, category, *_ in METRICS if category == "conversion"]
# Root-cause patterns as (name, priority, conditions of metric prefix, direction and severities).
PATTERNS = [
    ("payment_gateway_down", 100, [("payment_success_rate", "below", ("critical", "warning")), ("payment_gateway_failure", "below", ("critical",))]),
    ("purchase_pipeline_broken", 95, [("checkout_to_purchase_rate", "below", ()), ("funnel_break_purchase", "missing", ())]),
    ("cart_tracking_broken", 90, [("add_to_cart", "below", ()), ("add_to_cart_count", "missing", ())]),
    ("checkout_conversion_drop", 85, [("checkout_completion_rate", "below", ()), ("checkout_complete", "below", ())]),
    ("pricing_bug_spike", 80, [("avg_order_value", "above", ("critical",)), ("gross_revenue", "above", ())]),
    ("pricing_bug_zero", 80, [("avg_order_value", "below", ()), ("zero_revenue_bug", "below", ())]),
    ("traffic_source_issue", 75, [("unique_users_drop", "below", ()), ("unique_sessions_drop", "below", ())]),
    ("revenue_drop_with_stable_orders", 70, [("gross_revenue", "below", ()), ("order_count", "none", ())]),
    ("revenue_spike_fraud_check", 65, [("gross_revenue", "above", ("critical",)), ("avg_order_value", "above", ())]),
]
#: What each pattern tells its reader, from what it matched.
HINTS = {
    "payment_gateway_down": "Attempts to pay are there, successes are not. Ask whether anyone can still pay; compare one failed attempt end to end with one from before the hour.",
    "purchase_pipeline_broken": "Money was taken but no purchase was written. Reconcile payments with purchases of the hour before customers ask.",
    "cart_tracking_broken": "Carts went silent while other steps went on. Put something in a cart by hand and follow that event.",
    "checkout_conversion_drop": "People enter the checkout and leave it. Walk through it on a phone and on a desktop and note where it stops.",
    "pricing_bug_spike": "The same orders cost more. Compare prices of the best sellers with yesterday's.",
    "pricing_bug_zero": "Purchases carry no money. Buy the cheapest article and read the amount at every step.",
    "traffic_source_issue": "Fewer people arrive, whatever they do then. Split arrivals by where they come from and find the part that is gone.",
    "revenue_drop_with_stable_orders": "As many orders, less money. Look at what is in them: smaller baskets, cheaper articles, deeper discounts.",
    "revenue_spike_fraud_check": "A few orders may carry the hour. List the largest and ask who placed them.",
}
DEFAULT_HINT = "Nothing known looks like this. List what was changed in the hours before, and which of these metrics moved first."
SEVERITIES = ("critical", "warning", "info")


def rank(severity: Column) -> Column:
    """1 for critical, 2 for warning, 3 for others."""
    return F.when(severity == "critical", 1).when(severity == "warning", 2).otherwise(3)


def event_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_TYPES, "event_type string, event_category string, is_conversion_event boolean, funnel_order int")


def metric_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric_name string, metric_category string, unit string, higher_is_better boolean")


def currencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURRENCIES, "currency_code string, currency_name string, rate string").select("currency_code", "currency_name", F.col("rate").cast("decimal(12,6)").alias("usd_exchange_rate"))
