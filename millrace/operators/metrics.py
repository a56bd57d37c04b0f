"""Hourly counts, funnel, rates, revenue and the long metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import METRICS

COUNTS = [("page_views", "page_view"), ("product_views", "product_view"), ("add_to_cart", "add_to_cart"), ("checkout_start", "checkout_start"), ("checkout_complete", "checkout_complete"), ("payment_initiated", "payment_initiated"), ("payment_success", "payment_success"), ("payment_failed", "payment_failed"), ("purchases", "purchase")]
RATIOS = [("pv_to_product_rate", "product_views", "page_views"), ("product_to_cart_rate", "add_to_cart", "product_views"), ("cart_to_checkout_rate", "checkout_start", "add_to_cart"), ("checkout_completion_rate", "checkout_complete", "checkout_start"), ("checkout_to_purchase_rate", "purchases", "checkout_complete"), ("session_conversion_rate", "purchases", "unique_sessions"), ("payment_success_rate", "payment_success", "payment_initiated")]


def hour_of(column: str = "event_time") -> Column:
    return F.date_trunc("hour", F.col(column)).cast("timestamp_ntz")


def cents(column: str = "amount") -> Column:
    return (F.col(column) * 100).cast("bigint")


def ratio(n: Column, d: Column) -> Column:
    """Percent, 2 decimals, 0 without a denominator; multiplied first, so halves round alike everywhere."""
    return F.when(d > 0, F.round(n * F.lit(100.0) / d, 2)).otherwise(F.lit(0.0))


def per(cents_: Column, n: Column) -> Column:
    """Money per n, 2 decimals by integer arithmetic, 0 without n."""
    twice = 2 * cents_ + n
    half_up = (twice - F.pmod(twice, F.when(n > 0, 2 * n))) / F.when(n > 0, 2 * n)
    return F.when(n > 0, half_up / F.lit(100.0)).otherwise(F.lit(0.0))


#: What is told apart in an hour and type: users, sessions, orders paid for, and sessions that paid.
SEEN = ("user", "session", "order", "buyer")


def facts(events: DataFrame) -> DataFrame:
    """(hour_ts, event_type, kind, id, n, cents, paid_cents, paid): one row of sums for each hour and type (kind type), and one for each of its users, sessions, paid orders and paying sessions. Everything hourly comes from these, by one scan."""
    paid = (F.col("event_type") == "purchase") & (F.col("amount") > 0)
    own = lambda kind, id_, when=F.lit(True): F.when(when & id_.isNotNull(), F.struct(F.lit(kind).alias("kind"), id_.alias("id")))
    each = F.array(own("type", F.lit("")), own("user", F.col("user_id")), own("session", F.col("session_id")), own("order", F.col("order_id"), paid), own("buyer", F.col("session_id"), paid))
    money = F.when(F.col("amount") > 0, cents())
    rows = events.select(hour_of().alias("hour_ts"), "event_type", cents().alias("cents"), money.alias("money"), F.explode(each).alias("f")).where("f is not null").select("hour_ts", "event_type", "cents", "money", "f.*")
    return rows.groupBy("hour_ts", "event_type", "kind", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum("money").alias("paid_cents"), F.count("money").alias("paid"))


def tally(facts_: DataFrame) -> DataFrame:
    """One row for each hour and type of facts: sums, and how many users, sessions, orders and buyers there are."""
    own = lambda c: F.sum(F.when(F.col("kind") == "type", F.col(c))).alias(c)
    return facts_.groupBy("hour_ts", "event_type").agg(*[own(c) for c in ("n", "cents", "paid_cents", "paid")], *[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s") for k in SEEN])


def counts_of(tallied: DataFrame) -> DataFrame:
    """The event_counts of a tally."""
    mean = F.round(F.col("paid_cents") / F.lit(100.0) / F.when(F.col("paid") > 0, F.col("paid")), 6)
    return tallied.select("hour_ts", "event_type", F.col("n").alias("event_count"), F.col("users").alias("unique_users"), F.col("sessions").alias("unique_sessions"), (F.col("cents") / F.lit(100.0)).alias("total_amount"), mean.alias("avg_amount"))


def event_counts(events: DataFrame) -> DataFrame:
    """One row for each hour and type: events, distinct users and sessions, total and mean positive amount."""
    return counts_of(tally(facts(events)))


def funnel(counts: DataFrame) -> DataFrame:
    """event_counts with a column for each step; users and sessions are those of page views; hours without events have no row."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col(value))), F.lit(0))
    return counts.groupBy("hour_ts").agg(*[of(kind, "event_count").alias(name) for name, kind in COUNTS], of("page_view", "unique_users").alias("unique_users"), of("page_view", "unique_sessions").alias("unique_sessions"))


def conversion_rates(steps: DataFrame) -> DataFrame:
    return steps.select("hour_ts", *[ratio(F.col(n), F.col(d)).alias(name) for name, n, d in RATIOS])


def revenue_of(tallied: DataFrame) -> DataFrame:
    """The revenue of a tally."""
    sums = tallied.where((F.col("event_type") == "purchase") & (F.col("paid") > 0)).select("hour_ts", F.col("paid_cents").alias("cents"), F.col("orders").alias("order_count"), F.col("buyers").alias("purchasing_sessions"))
    return sums.select("hour_ts", (F.col("cents") / F.lit(100.0)).alias("gross_revenue"), "order_count", per(F.col("cents"), F.col("order_count")).alias("avg_order_value"), "purchasing_sessions")


def revenue(events: DataFrame) -> DataFrame:
    """Hours with paid purchases: revenue, distinct orders, order value, buying sessions."""
    return revenue_of(tally(facts(events.where((F.col("event_type") == "purchase") & (F.col("amount") > 0)))))


def revenue_per_session(steps: DataFrame, money: DataFrame) -> DataFrame:
    """Every hour of the funnel with its revenue, zeros where none."""
    both = steps.select("hour_ts", "unique_sessions").join(money, "hour_ts", "left")
    gross = F.coalesce("gross_revenue", F.lit(0.0))
    return both.select("hour_ts", gross.alias("gross_revenue"), F.coalesce("order_count", F.lit(0)).alias("order_count"), F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"), "unique_sessions", per(F.round(gross * 100).cast("bigint"), F.col("unique_sessions")).alias("revenue_per_session"))


def hourly_metrics_joined(events: DataFrame) -> DataFrame:
    """The wide table by joins of its parts."""
    steps = funnel(event_counts(events))
    money = revenue_per_session(steps, revenue(events)).drop("unique_sessions")
    return steps.join(conversion_rates(steps), "hour_ts", "left").join(money, "hour_ts", "left")


def hourly_metrics(events: DataFrame) -> DataFrame:
    """The wide table from one scan: events shrink to one row for each hour and type, and one for each hour and viewer, session or order, before they are shuffled."""
    viewed, paid = F.col("event_type") == "page_view", (F.col("event_type") == "purchase") & (F.col("amount") > 0)
    fact = lambda kind, id_, when=None: (lambda s: s if when is None else F.when(when & id_.isNotNull(), s))(F.struct(F.lit(kind).alias("kind"), id_.alias("id")))
    facts = F.array(fact("type", F.col("event_type")), fact("user", F.col("user_id"), viewed), fact("session", F.col("session_id"), viewed), fact("order", F.col("order_id"), paid))
    each = events.select(hour_of().alias("hour_ts"), F.when(paid, cents()).alias("cents"), F.explode(facts).alias("f")).where("f is not null").select("hour_ts", "cents", "f.*")
    once = each.groupBy("hour_ts", "kind", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    of_type = F.col("kind") == "type"
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = once.groupBy("hour_ts").agg(
        *[zero(F.sum(F.when(of_type & (F.col("id") == kind), F.col("n")))).alias(name) for name, kind in COUNTS],
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(name) for name, kind in (("unique_users", "user"), ("unique_sessions", "session"), ("order_count", "order"))], zero(F.sum(F.when(of_type, F.col("cents")))).alias("cents"),
    )
    return _wide(sums)


def wide_of(tallied: DataFrame) -> DataFrame:
    """The wide table of a tally."""
    is_ = lambda kind: F.col("event_type") == kind
    of = lambda kind, c: F.coalesce(F.sum(F.when(is_(kind), F.col(c))), F.lit(0))
    return _wide(tallied.groupBy("hour_ts").agg(*[of(kind, "n").alias(name) for name, kind in COUNTS], of("page_view", "users").alias("unique_users"), of("page_view", "sessions").alias("unique_sessions"), of("purchase", "orders").alias("order_count"), of("purchase", "paid_cents").alias("cents")))


def _wide(sums: DataFrame) -> DataFrame:
    wide = sums.select("*", *[ratio(F.col(n), F.col(d)).alias(name) for name, n, d in RATIOS])
    return wide.select(
        "hour_ts", *[n for n, _ in COUNTS], "unique_users", "unique_sessions", *[n for n, *_ in RATIOS],
        (F.col("cents") / F.lit(100.0)).alias("gross_revenue"), "order_count", per(F.col("cents"), F.col("order_count")).alias("avg_order_value"), per(F.col("cents"), F.col("unique_sessions")).alias("revenue_per_session"),
    )


def metrics_long(wide: DataFrame) -> DataFrame:
    """(hour_ts, metric_name, metric_value): 18 rows for each hour, by one unpivot."""
    names = [m for m, *_ in METRICS]
    return wide.select("hour_ts", *[F.col(m).cast("double").alias(m) for m in names]).unpivot("hour_ts", names, "metric_name", "metric_value")
