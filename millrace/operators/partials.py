"""Hourly aggregates that add up: sums, and bitmaps of who was there, so that distinct counts of hours merge to those of any window.

Ids are numbered once, from 1, each kind by itself; a bitmap holds the numbers of one range of 32,768 (a bucket), so an hour, type and kind has as many rows as ranges that occur in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..sources.tables import kept
from . import metrics, rules

IDS = "kind string, id string, n bigint"
SUMS = "hour_ts timestamp_ntz, event_type string, n bigint, cents bigint, paid_cents bigint, paid bigint"
MARKS = "hour_ts timestamp_ntz, event_type string, kind string, bucket bigint, bits binary"
#: Kinds of marks and the kind of id that each marks.
NUMBERED = {"user": "user", "session": "session", "order": "order", "buyer": "session"}
#: Parts in which new ids are numbered.
PARTS = 256


def id_kind(kind: Column) -> Column:
    return F.when(kind == "buyer", "session").otherwise(kind)


def numbered(facts: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, id, n) of the ids of facts that known lacks, with the numbers after those of known. New ids are numbered in parts by hash; only the sizes of parts are added up in one place."""
    new = facts.where("kind <> 'type'").select(id_kind(F.col("kind")).alias("kind"), "id").distinct().join(known.select("kind", "id"), ["kind", "id"], "left_anti")
    new = kept(new.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))))
    sizes = new.groupBy("kind", "_part").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.coalesce(F.sum("_size").over(Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTS rows a kind
    last = known.groupBy("kind").agg(F.max("n").alias("_last"))
    starts = sizes.select("kind", "_part", upto.alias("_upto")).join(last, "kind", "left").select("kind", "_part", (F.col("_upto") + F.coalesce("_last", F.lit(0))).alias("_from"))
    place = F.row_number().over(Window.partitionBy("kind", "_part").orderBy("id"))
    return new.withColumn("_place", place).join(F.broadcast(starts), ["kind", "_part"]).select("kind", "id", (F.col("_from") + F.col("_place")).alias("n"))


def sums(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'type'").select("hour_ts", "event_type", "n", "cents", "paid_cents", "paid")


def marks(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The bitmaps of facts; ids must know all of them."""
    own = facts.where("kind <> 'type'").select("hour_ts", "event_type", F.col("kind").alias("mark"), id_kind(F.col("kind")).alias("kind"), "id").join(ids, ["kind", "id"])
    return own.groupBy("hour_ts", "event_type", F.col("mark").alias("kind"), F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merged(marks_: DataFrame, *by: str) -> DataFrame:
    """(by, kind, n): distinct ids of each kind over the marks that share by, whatever hours and types they come from."""
    return marks_.groupBy(*by, "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy(*by, "kind").agg(F.sum("n").alias("n"))


def across(marks_: DataFrame, *by: str) -> DataFrame:
    """(by, users, sessions, orders, buyers): the merged counts, a column for each kind."""
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}s")
    return merged(marks_, *by).groupBy(*by).agg(*[of(k) for k in metrics.SEEN])


def tally(sums_: DataFrame, marks_: DataFrame) -> DataFrame:
    """What ``metrics.tally`` gives, from stored sums and bitmaps."""
    counts = across(marks_, "hour_ts", "event_type")
    zero = [F.coalesce(f"{k}s", F.lit(0)).alias(f"{k}s") for k in metrics.SEEN]
    return sums_.join(counts, ["hour_ts", "event_type"], "left").select(*sums_.columns, *zero)


def traffic_drops(marks_: DataFrame, windows: DataFrame | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """``rules.traffic_drops`` from bitmaps: hours merge their types, windows merge their hours. Without windows, every hour that has marks is one."""
    own = marks_.where("kind in ('user', 'session')")
    hourly = kept(across(own, "hour_ts").select("hour_ts", "users", "sessions"))
    if windows is None:
        windows = seen = hourly.withColumnRenamed("hour_ts", "window_start")
    else:
        inside = rules._hours_of(windows).join(own, "hour_ts")
        seen = windows.select("window_start").join(across(inside, "window_start"), "window_start", "left").select("window_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("users", "sessions")])
    return rules.dropped(hourly, windows, seen, cfg)


def all_rules(sums_: DataFrame, marks_: DataFrame, windows: DataFrame | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """``rules.all_rules`` from stored sums and bitmaps."""
    counts = kept(rules.counts_of(sums_))
    told = rules.window_facts(counts, rules.hourly_windows(None, counts) if windows is None else windows, cfg)
    return rules.fired_of(told, cfg).unionByName(traffic_drops(marks_, windows, cfg))
