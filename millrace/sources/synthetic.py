"""A seeded month of shop events with known faults, made by Spark columns alone."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Shop:
    """How busy the invented shop is: two bumps over the day's hours on a floor, as (hour, width, height); what weekends take off; how far an hour strays from that; the mean and
    spread of the log of what an order costs, its least and most; the share of purchases that a lost-purchase fault swallows and of checkouts that a slump leaves; and the share of those that took the step before who take the next."""

    floor: float = 0.15
    bumps: tuple = ((13.0, 3.5, 0.9), (20.0, 2.5, 0.8))
    weekend: float = 0.75
    noise: float = 0.2
    spend: tuple = (3.8, 0.7)
    least: float = 5.0
    most: float = 900.0
    lost: float = 0.9
    slump: float = 0.25
    steps: tuple = (("page_view", 1.0), ("product_view", 0.65), ("add_to_cart", 0.3), ("checkout_start", 0.55), ("checkout_complete", 0.8), ("payment_initiated", 1.0), ("payment_success", 0.94), ("purchase", 0.96))

    def busy(self, hour: int) -> float:
        """Share of the base load; distances go round the clock."""
        return self.floor + sum(h * exp(-((min(abs(hour - at), 24 - abs(hour - at)) / w) ** 2)) for at, w, h in self.bumps)


def generate(spark: SparkSession, end: datetime, days: int = 30, sessions: int = 100, seed: int = 42, faults: bool = True, shop: Shop = Shop()) -> DataFrame:
    """Canonical events of the days before end (a whole hour): sessions follow the day's curve and fall through the funnel by hashes of
    their number, so any partitioning gives the same rows. Faults stand at fixed distances from the end."""
    start = end - timedelta(days=days)
    u = lambda *salt: F.pmod(F.xxhash64("id", *[F.lit(s) for s in (seed, *salt)]), F.lit(1_000_000)) / F.lit(1e6)
    most = int(sessions * 1.5)
    ids = spark.range(days * 24 * most)
    hour = F.expr(f"timestampadd(HOUR, cast(id div {most} as int), timestamp_ntz'{start:%Y-%m-%d %H:%M:%S}')")
    load = F.element_at(F.array(*[F.lit(shop.busy(h)) for h in range(24)]), F.hour("hour_ts") + 1) * F.when(F.dayofweek("hour_ts").isin(1, 7), shop.weekend).otherwise(1.0) * sessions
    rows = ids.withColumn("hour_ts", hour).where((F.col("id") % most) < load * (F.lit(1 - shop.noise) + 2 * shop.noise * F.pmod(F.xxhash64("hour_ts", F.lit(seed)), F.lit(1000)) / 1000))
    before = lambda n, long: (F.col("hour_ts") >= F.lit(end - timedelta(hours=n)).cast("timestamp_ntz")) & (F.col("hour_ts") < F.lit(end - timedelta(hours=n - long)).cast("timestamp_ntz"))
    on = lambda cond: cond if faults else F.lit(False)
    reach, steps = F.lit(True), []
    amount = F.greatest(F.lit(shop.least), F.least(F.lit(shop.most), F.exp(F.lit(shop.spend[0]) + shop.spend[1] * F.sqrt(-2 * F.log(u("a") + 1e-9)) * F.cos(2 * F.pi() * u("b")))))
    amount = F.when(on(before(12, 1)), amount * 5).when(on(before(6, 1)), 0.0).otherwise(amount)

    def step(kind: str, cond: Column, k: int) -> Column:
        when = F.col("hour_ts") + F.make_dt_interval(secs=(u("t") * 3000 + 60 * k).cast("decimal(18,6)"))
        money = F.round(amount, 2) if kind in ("payment_success", "purchase") else F.lit(0.0)
        return F.when(cond, F.struct(F.lit(kind).alias("event_type"), when.alias("event_time"), money.cast("decimal(12,2)").alias("amount")))

    for k, (kind, share) in enumerate(shop.steps):
        if kind == "checkout_complete":
            share = F.when(on(before(24, 2)), share * shop.slump).otherwise(share)
        last, reach = reach, reach & (u(kind) < share)
        seen = reach
        if kind == "purchase":
            seen = reach & ~(on(before(48, 3)) & (u("lost") < shop.lost))
        if kind == "add_to_cart":
            seen = reach & ~on(before(4, 2))
        steps.append(step(kind, seen, k))
        if kind == "payment_success":
            steps.append(step("payment_failed", last & ~reach, k))
    steps += [step("page_view", u("more", k) < 0.5, 0) for k in range(2)]
    each = rows.withColumn("e", F.explode(F.array_compact(F.array(*steps))))
    return each.select(
        F.xxhash64("id", F.col("e.event_type"), F.col("e.event_time")).alias("event_id"), F.col("e.event_time").alias("event_time"), F.concat(F.lit("USR-"), F.lower(F.hex(F.xxhash64("id", F.lit(seed))))).alias("user_id"), F.concat(F.lit("SES-"), F.col("id").cast("string")).alias("session_id"),
        F.col("e.event_type").alias("event_type"), F.col("e.amount").alias("amount"), F.lit("USD").alias("currency"), F.when(F.col("e.event_type").isin("checkout_start", "checkout_complete", "payment_initiated", "payment_success", "payment_failed", "purchase"), F.concat(F.lit("ORD-"), F.col("id").cast("string"))).alias("order_id"),
    )
