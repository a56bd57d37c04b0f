"""The test tables' events and orders as canonical commercial events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(events: DataFrame) -> DataFrame:
    """Canonical events of (event_id, ts, user_id, event_type, value, props); rows without a time or a known type have no counterpart."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    canon = (
        F.when((kind == "view") & (k < 70), "page_view").when(kind == "view", "product_view")
        .when((kind == "click") & (k < 45), "add_to_cart").when(kind == "click", "checkout_start")
        .when(kind == "signup", "payment_initiated")
        .when((kind == "purchase") & (k < 45), "purchase").when(kind == "purchase", "checkout_complete")
        .when((kind == "error") & (k < 85), "payment_success").when(kind == "error", "payment_failed")
    )
    user = F.col("user_id").cast("string")
    rows = events.where(F.col("ts").isNotNull()).select("event_id", F.col("ts").cast("timestamp_ntz").alias("event_time"), user.alias("user_id"), F.concat(user, F.lit("-"), F.date_format("ts", "yyyyMMddHH")).alias("session_id"), canon.alias("event_type"), F.col("value"))
    bought = F.col("event_type") == "purchase"
    return rows.where(F.col("event_type").isNotNull()).select(
        "event_id", "event_time", "user_id", "session_id", "event_type",
        F.when(bought, F.col("value").cast("decimal(12,2)")).otherwise(F.lit(0).cast("decimal(12,2)")).alias("amount"),
        F.lit("USD").alias("currency"), F.when(bought, F.col("event_id").cast("string")).alias("order_id"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark.read.parquet(f"{sf_dir}/events.parquet"))


def injected(events: DataFrame) -> DataFrame:
    """Canonical events with three faults: no add_to_cart on the 20th from 10 to 14, no purchase on the 21st from 3 to 7, purchases of nothing on the 22nd."""
    day, hour = F.dayofmonth("event_time"), F.hour("event_time")
    gone = ((F.col("event_type") == "add_to_cart") & (day == 20) & hour.between(10, 13)) | ((F.col("event_type") == "purchase") & (day == 21) & hour.between(3, 6))
    free = (F.col("event_type") == "purchase") & (day == 22)
    return events.where(~gone).withColumn("amount", F.when(free, F.lit(0).cast("decimal(12,2)")).otherwise(F.col("amount")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.col("o_orderstatus").alias("status"))
