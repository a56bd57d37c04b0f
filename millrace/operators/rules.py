"""Rule detectors, for any number of whole-hour windows at once.

Events are first summed by hour: one row of counts for each hour, and one row for each hour and user or session. Windows meet only those, by equi-joins on hours and days, so a hot
hour is spread over its users, and everything after the first aggregation grows with hours and distinct users, not with events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig, Window
from ..schema import EVENT_TYPES
from ..sources.tables import kept
from .baselines import at, hours
from .metrics import cents, hour_of
from .statistical import SHAPE, document, money

KINDS = [k for k, *_ in EVENT_TYPES]


def hour_counts(events: DataFrame) -> DataFrame:
    """One row for each hour: how often each known type came (null if never), and the cents of purchases."""
    of = lambda kind, value: F.sum(F.when(F.col("event_type") == kind, value))
    return events.groupBy(hour_of().alias("hour_ts")).agg(*[of(k, F.lit(1)).alias(k) for k in KINDS], of("purchase", cents()).alias("cents"))


def counts_of(tallied: DataFrame) -> DataFrame:
    """The hour_counts of a tally of facts."""
    of = lambda kind, c: F.sum(F.when(F.col("event_type") == kind, F.col(c)))
    return tallied.groupBy("hour_ts").agg(*[of(k, "n").alias(k) for k in KINDS], of("purchase", "cents").alias("cents"))


def visitors_of(facts: DataFrame) -> DataFrame:
    """The hour_visitors of facts: of each hour once, whatever they did."""
    return facts.where("kind in ('user', 'session')").select("hour_ts", F.concat("kind", F.lit("s")).alias("kind"), "id").distinct()


def hour_visitors(events: DataFrame) -> DataFrame:
    """(hour_ts, kind, id): the distinct users and sessions of each hour."""
    both = F.explode(F.array(F.struct(F.lit("users").alias("kind"), F.col("user_id").alias("id")), F.struct(F.lit("sessions").alias("kind"), F.col("session_id").alias("id"))))
    return events.select(hour_of().alias("hour_ts"), both.alias("v")).select("hour_ts", "v.*").distinct()


def hourly_windows(events: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Every hour that has events, as a window of its own."""
    hour = (hour_counts(events) if counts is None else counts).select(F.col("hour_ts").alias("window_start"))
    return hour.select("window_start", (F.col("window_start") + hours(1)).alias("window_end"))


def one_window(events: DataFrame, window: Window) -> DataFrame:
    return events.sparkSession.range(1).select(at(window.start).alias("window_start"), at(window.end).alias("window_end"))


def _hours_of(windows: DataFrame) -> DataFrame:
    return windows.select("window_start", "window_end", F.explode(F.sequence("window_start", F.col("window_end") - hours(1), F.expr("INTERVAL 1 HOUR"))).alias("hour_ts"))


def _before(windows: DataFrame, hourly: DataFrame, days: int) -> DataFrame:
    """Rows of hourly (hour_ts, ...) in the days before each window: an equi-join on days, then the exact band."""
    day = lambda c: F.to_date(c)
    dealt = windows.select("window_start", F.explode(F.sequence(F.date_sub(day(F.col("window_start")), days), day(F.col("window_start")))).alias("_day"))
    joined = hourly.withColumn("_day", day(F.col("hour_ts"))).join(dealt, "_day")
    return joined.where((F.col("hour_ts") >= F.col("window_start") - hours(24 * days)) & (F.col("hour_ts") < F.col("window_start"))).drop("_day")


def window_facts(counts: DataFrame, windows: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """One row for each window: its counts, and what is usual in the week before: usual_<type> (mean of the hours that had some), usual_rate (of payments), usual_cents."""
    own = _hours_of(windows).join(counts, "hour_ts", "left").groupBy("window_start", "window_end").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*KINDS, "cents")])
    tried = F.col("payment_initiated") > cfg.gateway_hour_initiated
    rate = F.when(tried, F.coalesce("payment_success", F.lit(0)) * F.lit(100.0) / F.col("payment_initiated"))
    bought = F.when(F.col("purchase").isNotNull(), F.col("cents"))
    week = _before(windows, counts, 7).groupBy("window_start").agg(*[F.avg(k).alias(f"usual_{k}") for k in KINDS], F.avg(rate).alias("usual_rate"), (F.sum(bought) / (F.count(bought) * F.lit(100.0))).alias("usual_cents"))
    return own.join(week, "window_start", "left")


def _hit(when: Column, rule: str, metric: Column | str, value: Column, severity: Column | str, direction: str, text: Column, mean: Column | None = None, **facts: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("double")
    return F.when(when, F.struct(
        F.lit(rule).alias("rule"), lit(metric).alias("metric_name"), value.cast("double").alias("current_value"), (none if mean is None else mean.cast("double")).alias("baseline_mean"),
        lit(severity).alias("severity"), F.lit(direction).alias("direction"), text.alias("description"), document(**facts).alias("metadata_json"),
    ))


def _missing(cfg: DetectionConfig) -> list[Column]:
    """Types of events that usually come and don't in the window."""
    usual = lambda k: F.col(f"usual_{k}")
    return [
        _hit((usual(k) > cfg.missing_baseline) & (F.col(k) == 0), "missing_event_types", f"{k}_count", F.lit(0), "critical" if conversion else "warning", "missing", F.concat(F.lit(f"no {k} events, usually "), money(usual(k)), F.lit(" an hour")), F.round(usual(k), 4),
             event_type=F.lit(k), is_conversion_event=F.lit(conversion), baseline_avg_count=F.round(usual(k), 4), window_start=F.col("window_start").cast("string"), window_end=F.col("window_end").cast("string"))
        for k, _, conversion, _ in EVENT_TYPES
    ]


def _funnel(cfg: DetectionConfig) -> list[Column]:
    """Later steps of the funnel without the earlier ones."""
    cart, start, done, paid, bought = (F.col(c) for c in ("add_to_cart", "checkout_start", "checkout_complete", "payment_success", "purchase"))
    zero, rate = F.lit(0.0), F.round(bought * F.lit(100.0) / F.when(done > 0, done), 6)
    text = lambda metric: F.concat(F.lit(f"{metric}: "), start, F.lit(" started, "), done, F.lit(" completed, "), paid, F.lit(" paid, "), bought, F.lit(" bought"))
    return [
        _hit((start > 0) & (cart == 0), "funnel_breaks", "funnel_break_cart", zero, "critical", "missing", text("funnel_break_cart"), checkout_start=start, add_to_cart=cart),
        _hit((done > 0) & (start == 0), "funnel_breaks", "funnel_break_checkout", zero, "critical", "missing", text("funnel_break_checkout"), checkout_complete=done, checkout_start=start),
        _hit((paid > cfg.funnel_success) & (bought == 0), "funnel_breaks", "funnel_break_purchase", zero, "critical", "missing", text("funnel_break_purchase"), payment_success=paid, purchases=bought),
        _hit((done > cfg.funnel_complete) & (bought < done * cfg.funnel_share), "funnel_breaks", "funnel_break_conversion", rate, "warning", "below", text("funnel_break_conversion"), checkout_complete=done, purchases=bought, conversion_rate=rate),
    ]


def _gateway(cfg: DetectionConfig) -> list[Column]:
    """No payment succeeds, or far fewer than in the hours of the week before."""
    tried, ok, failed, mean = (F.col(c) for c in ("payment_initiated", "payment_success", "payment_failed", "usual_rate"))
    rate = ok * F.lit(100.0) / F.when(tried > 0, tried)
    down, low = ok == 0, F.coalesce(rate < mean * cfg.gateway_warning, F.lit(False))
    severity = F.when(down | (rate < mean * cfg.gateway_critical), "critical").otherwise("warning")
    text = F.concat(ok, F.lit(" of "), tried, F.lit(" payments succeeded, "), failed, F.lit(" failed"))
    metric = F.when(down, "payment_gateway_failure").otherwise("payment_success_rate_drop")
    return [_hit((tried > cfg.gateway_initiated) & (down | low), "payment_gateway", metric, F.when(down, 0.0).otherwise(F.round(rate, 6)), severity, "below", text, F.round(mean, 8), initiated=tried, success=ok, failed=failed, current_rate=F.round(rate, 6), baseline_rate=F.round(mean, 8))]


def _revenue(cfg: DetectionConfig) -> list[Column]:
    """Purchases that bring nothing, or revenue far below that of the week's hours with purchases."""
    bought, mean, total = F.col("purchase"), F.col("usual_cents"), F.col("cents") / F.lit(100.0)
    nothing = (bought > 0) & (F.col("cents") == 0)
    near = F.coalesce((mean > cfg.revenue_baseline) & (total < mean * cfg.revenue_share), F.lit(False))
    metric, text = F.when(nothing, "zero_revenue_bug").otherwise("near_zero_revenue"), F.concat(bought, F.lit(" purchases, revenue "), money(total))
    return [_hit(nothing | near, "zero_revenue", metric, F.when(nothing, 0.0).otherwise(total), "critical", "below", text, F.round(mean, 4), purchase_count=bought, total_revenue=total, baseline_avg=F.round(mean, 4))]


def _fired(facts: DataFrame, hits: list[Column]) -> DataFrame:
    none = F.lit(None).cast("double")
    rows = facts.select(F.col("window_start").alias("metric_timestamp"), F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("metric_timestamp", "hit.*")
    return rows.withColumns({c: none for c in ("baseline_std", "baseline_q1", "baseline_q3", "baseline_iqr", "z_score", "iqr_distance", "pct_change")} | {"detector": F.lit("rules")}).select(*SHAPE)


def missing_event_types(events: DataFrame, windows: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return _fired(window_facts(hour_counts(events), windows, cfg), _missing(cfg))


def funnel_breaks(events: DataFrame, windows: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return _fired(window_facts(hour_counts(events), windows, cfg), _funnel(cfg))


def payment_gateway(events: DataFrame, windows: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return _fired(window_facts(hour_counts(events), windows, cfg), _gateway(cfg))


def zero_revenue(events: DataFrame, windows: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return _fired(window_facts(hour_counts(events), windows, cfg), _revenue(cfg))


def visitor_counts(visitors: DataFrame, *by: str) -> DataFrame:
    of = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("id"))).alias(kind)
    return visitors.groupBy(*by).agg(of("users"), of("sessions"))


def traffic_drops(events: DataFrame | None, windows: DataFrame | None = None, cfg: DetectionConfig = DetectionConfig(), visitors: DataFrame | None = None) -> DataFrame:
    """Users and sessions of all events against the same hour of the four weeks before; few usual users silence both. Without windows, every hour that has events is one. visitors: those of hours, where they are at hand."""
    visitors = hour_visitors(events) if visitors is None else visitors
    if windows is None:  # an hour's visitors are those of its window
        hourly = kept(visitor_counts(visitors, "hour_ts"))
        windows = seen = hourly.withColumnRenamed("hour_ts", "window_start")
    else:
        hourly = visitor_counts(visitors, "hour_ts")
        seen = visitor_counts(_hours_of(windows).join(visitors, "hour_ts", "left").select("window_start", "kind", "id").distinct(), "window_start")
    return dropped(hourly, windows, seen, cfg)


def dropped(hourly: DataFrame, windows: DataFrame, seen: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """traffic_drops of hourly (hour_ts, users, sessions) and of windows with what each has seen (window_start, users, sessions)."""
    weeks = windows.select("window_start", F.explode(F.array(*[F.date_trunc("hour", F.col("window_start")).cast("timestamp_ntz") - hours(168 * k) for k in (1, 2, 3, 4)])).alias("hour_ts"))
    usual = weeks.join(hourly, "hour_ts").groupBy("window_start").agg(*[f(c).alias(f"{n}_{c}") for c in ("users", "sessions") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    both = seen.join(usual, "window_start").where(F.col("mean_users") > cfg.traffic_users)
    pair = lambda c: F.struct(F.lit(f"unique_{c}_drop").alias("metric"), F.lit(c).alias("what"), F.col(c).alias("value"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"))
    hit = both.select("window_start", F.explode(F.array(pair("users"), pair("sessions"))).alias("h")).select("window_start", "h.*").where(F.col("value") < F.col("mean") * (1 - cfg.traffic_drop))
    severity = F.when(F.col("value") < F.col("mean") * cfg.traffic_critical, "critical").otherwise("warning")
    pct, none = F.round((F.col("value") - F.col("mean")) / F.col("mean") * 100, 4), F.lit(None).cast("double")
    return hit.select(
        F.col("metric").alias("metric_name"), F.col("window_start").alias("metric_timestamp"), F.col("value").cast("double").alias("current_value"), F.round("mean", 4).alias("baseline_mean"), F.round("std", 4).alias("baseline_std"),
        *[none.alias(c) for c in ("baseline_q1", "baseline_q3", "baseline_iqr", "z_score", "iqr_distance")], pct.alias("pct_change"), F.lit("rules").alias("detector"), F.lit("traffic_drops").alias("rule"), severity.alias("severity"), F.lit("below").alias("direction"),
        F.concat(F.lit("only "), F.col("value"), F.lit(" "), F.col("what"), F.lit(", usually "), money(F.col("mean"))).alias("description"), document(current=F.col("value"), baseline_avg=F.round("mean", 4), drop_pct=-pct).alias("metadata_json"),
    ).select(*SHAPE)


def all_rules(events: DataFrame | None, windows: DataFrame | None = None, cfg: DetectionConfig = DetectionConfig(), facts: DataFrame | None = None) -> DataFrame:
    """All rules; without windows, over every hour that has events. The rules on counts share one pass over the windows' facts. facts: the events' hourly facts, written, where they are at hand; events aren't read then."""
    counts = kept(hour_counts(events) if facts is None else counts_of(facts.where("kind = 'type'")))  # one row for each hour
    told = window_facts(counts, hourly_windows(events, counts) if windows is None else windows, cfg)
    drops = traffic_drops(events, windows, cfg, None if facts is None else visitors_of(facts))
    return fired_of(told, cfg).unionByName(drops)


def fired_of(told: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """All rules on counts over window_facts."""
    return _fired(told, [*_missing(cfg), *_funnel(cfg), *_gateway(cfg), *_revenue(cfg)])
