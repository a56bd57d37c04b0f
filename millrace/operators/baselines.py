"""Rolling and seasonal baselines, and metrics set against them."""

from __future__ import annotations

import bisect
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workers import ship

STATS = ("rolling_mean", "rolling_std", "rolling_min", "rolling_max", "percentile_25", "percentile_50", "percentile_75", "iqr")


def at(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def hours(n) -> Column:
    return F.make_interval(hours=F.lit(int(n)))


def epoch(column: str) -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


def stored(x: Column) -> Column:
    """As a baseline store keeps it: six decimals."""
    return x.cast("decimal(18,6)").cast("double")


def _stats(over=lambda x: x) -> list[Column]:
    v = F.col("metric_value")
    q = over(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    # values have two decimals: their sum in hundredths is exact in any order
    mean = over(F.sum(F.round(v * 100).cast("bigint"))) / (over(F.count(v)) * F.lit(100.0))
    return [stored(mean).alias("rolling_mean"), stored(over(F.stddev_samp(v))).alias("rolling_std"), stored(over(F.min(v))).alias("rolling_min"), stored(over(F.max(v))).alias("rolling_max"), *[stored(q[k]).alias(f"percentile_{p}") for k, p in enumerate((25, 50, 75))], stored(q[2] - q[0]).alias("iqr"), over(F.count(v)).alias("sample_count")]


def rolling_baseline(long: DataFrame, as_of: datetime, periods: int = 168, min_samples: int = 24) -> DataFrame:
    """Statistics of every metric over the observed hours in [as_of - periods, as_of); metrics with fewer samples have none."""
    seen = long.where((F.col("hour_ts") >= at(as_of) - hours(periods)) & (F.col("hour_ts") < at(as_of)))
    return seen.groupBy("metric_name").agg(*_stats()).where(F.col("sample_count") >= min_samples).select(
        "metric_name", at(as_of).alias("computed_at"), F.lit(periods).alias("baseline_periods"), (at(as_of) - hours(periods)).alias("period_start"), at(as_of).alias("period_end"), *STATS, "sample_count"
    )


def rolling_baseline_frames(long: DataFrame, periods: int = 168, baseline_end: str = "window_end", min_samples: int = 24) -> DataFrame:
    """``rolling_baseline_all_hours`` by a range frame for each metric: every hour sorts its frame anew, and a metric is one task."""
    first, last = (-(periods - 1), 0) if baseline_end == "window_end" else (-periods, -1)
    span = Window.partitionBy("metric_name").orderBy(epoch("hour_ts")).rangeBetween(first * 3600, last * 3600)
    rows = long.select("hour_ts", "metric_name", "metric_value", *_stats(lambda x: x.over(span)))
    return rows.where(F.col("sample_count") >= min_samples)


class Sliding:
    """Values in order, which a frame's end enters and its begin leaves; order statistics by place, the sum in hundredths exact."""

    def __init__(self):
        self.sorted, self.hundredths = [], 0

    def enter(self, v: float) -> None:
        bisect.insort(self.sorted, v)
        self.hundredths += _hundredths(v)

    def leave(self, v: float) -> None:
        del self.sorted[bisect.bisect_left(self.sorted, v)]
        self.hundredths -= _hundredths(v)

    def quantile(self, p: float) -> float:
        """Interpolated between the values at both sides of p * (n - 1)."""
        place = p * (len(self.sorted) - 1)
        low = int(place)
        if low == place:
            return self.sorted[low]
        return (low + 1 - place) * self.sorted[low] + (place - low) * self.sorted[low + 1]


def _hundredths(v: float) -> int:
    return int(abs(v) * 100 + 0.5) * (1 if v >= 0 else -1)


def slide(hour: np.ndarray, value: np.ndarray, asked: np.ndarray, first: int, last: int) -> list[tuple]:
    """(row, mean, std, least, largest, quartiles, count) for the asked rows of one metric, hours ascending; a frame is [hour + first, hour + last]; values that are no numbers aren't in any."""
    frame, out, start, end = Sliding(), [], 0, 0
    there = ~np.isnan(value)
    for i in np.flatnonzero(asked):
        while end < len(hour) and hour[end] <= hour[i] + last:
            if there[end]:
                frame.enter(float(value[end]))
            end += 1
        while start < end and hour[start] < hour[i] + first:
            if there[start]:
                frame.leave(float(value[start]))
            start += 1
        n = len(frame.sorted)
        if n:
            own = np.array(frame.sorted)
            q = [frame.quantile(p) for p in (0.25, 0.5, 0.75)]
            out.append((i, frame.hundredths / (n * 100.0), float(own.std(ddof=1)) if n > 1 else None, frame.sorted[0], frame.sorted[-1], *q, q[2] - q[0], n))
    return out


def rolling_baseline_all_hours(long: DataFrame, periods: int = 168, baseline_end: str = "window_end", min_samples: int = 24, block: int | None = None) -> DataFrame:
    """The baseline that each hour's one-hour window is tested against, all windows in one pass.

    baseline_end window_end: the frame ends with the hour itself; window_start: just before it. A metric's time is cut into blocks of hours (two frames long, if not said otherwise), each a group of its own with the hours before it that its
    frames reach, so the work is parallel over time too; within a block, a frame's values are kept in order while it slides."""
    ship(long.sparkSession)
    first, last = (-(periods - 1), 0) if baseline_end == "window_end" else (-periods, -1)
    size = block or 2 * periods
    hour = F.floor(epoch("hour_ts") / 3600).cast("bigint")
    own = F.floor(hour / size)
    reached = F.explode(F.sequence(own, F.floor((hour - first) / size)))  # its own block, and those whose first frames reach back to it
    rows = long.select("hour_ts", "metric_name", "metric_value", hour.alias("hour"), own.alias("own"), reached.alias("block"))
    names = ["rolling_mean", "rolling_std", "rolling_min", "rolling_max", "percentile_25", "percentile_50", "percentile_75", "iqr", "sample_count"]
    raw = [f"{n} {'bigint' if n == 'sample_count' else 'double'}" for n in names]

    def each(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["hour"].to_numpy(), kind="stable")))
        asked = t["own"].to_numpy() == t["block"].to_numpy()
        found = slide(t["hour"].to_numpy(), t["metric_value"].to_numpy(zero_copy_only=False).astype(float), asked, first, last)
        at_, *columns = zip(*found, strict=True) if found else [()] * (len(names) + 1)
        kinds = [pa.float64()] * (len(names) - 1) + [pa.int64()]
        own_rows = t.select(["hour_ts", "metric_name", "metric_value"]).take(pa.array(at_, pa.int64()))
        return pa.table([*own_rows.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["hour_ts", "metric_name", "metric_value", *names])

    found = rows.groupBy("metric_name", "block").applyInArrow(each, f"hour_ts timestamp_ntz, metric_name string, metric_value double, {', '.join(raw)}")
    return found.where(F.col("sample_count") >= min_samples).select("hour_ts", "metric_name", "metric_value", *[stored(F.col(n)).alias(n) for n in STATS], "sample_count")


def current_baselines(baselines: DataFrame) -> DataFrame:
    """The latest baseline of each metric."""
    latest = baselines.groupBy("metric_name").agg(F.max_by(F.struct(*[c for c in baselines.columns if c != "metric_name"]), "computed_at").alias("b"))
    return latest.select("metric_name", "b.*")


def baseline_asof(baselines: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (metric_name, asked_at): the latest baseline computed by then, if there is one. Linear after one sort: both sides in one line of time, the last baseline carried on."""
    kept = ("computed_at", "rolling_mean", "rolling_std", "percentile_25", "percentile_75", "iqr", "sample_count")
    base = baselines.select("metric_name", F.col("computed_at").alias("t"), F.lit(0).alias("asks"), F.struct(*kept).alias("b"))
    both = base.unionByName(asked.select("metric_name", F.col("asked_at").alias("t"), F.lit(1).alias("asks"), F.lit(None).cast(base.schema["b"].dataType).alias("b")))
    line = Window.partitionBy("metric_name").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("b", F.last("b", ignorenulls=True).over(line)).where((F.col("asks") == 1) & F.col("b").isNotNull())
    return found.select("metric_name", F.col("t").alias("asked_at"), "b.*").distinct()


def compare(rows: DataFrame, iqr_multiplier: float = 1.5) -> DataFrame:
    """(hour_ts, metric_name, metric_value, statistics) with z, fences and change from the mean."""
    v, mean, std, q1, q3, iqr = (F.col(c) for c in ("metric_value", "rolling_mean", "rolling_std", "percentile_25", "percentile_75", "iqr"))
    return rows.select(
        "hour_ts", "metric_name", "metric_value", mean.alias("baseline_mean"), std.alias("baseline_std"), q1.alias("baseline_q1"), F.col("percentile_50").alias("baseline_median"), q3.alias("baseline_q3"), iqr.alias("baseline_iqr"),
        F.col("rolling_min").alias("baseline_min"), F.col("rolling_max").alias("baseline_max"), F.col("sample_count").alias("baseline_sample_count"),
        F.when(std > 0, (v - mean) / std).otherwise(F.lit(0.0)).alias("z_score"), (q1 - iqr_multiplier * iqr).alias("iqr_lower_bound"), (q3 + iqr_multiplier * iqr).alias("iqr_upper_bound"),
        F.when(mean > 0, (v - mean) / mean * 100).otherwise(F.lit(0.0)).alias("pct_change_from_mean"),
    )


def metrics_with_baseline(long: DataFrame, current: DataFrame, iqr_multiplier: float = 1.5) -> DataFrame:
    """Every hour against the current baselines: a row for each metric at most, so the right side is small by definition."""
    return compare(long.join(F.broadcast(current.select("metric_name", *STATS, "sample_count")), "metric_name", "left"), iqr_multiplier)


def _seasonal(rows: DataFrame) -> DataFrame:
    std = F.col("same_hour_std")
    z = F.when(std > 0, (F.col("current_value") - F.col("same_hour_mean")) / std).otherwise(F.lit(0.0))
    return rows.where("sample_count >= 2").select("metric_name", "current_hour", "current_value", F.round("same_hour_mean", 6).alias("same_hour_mean"), F.round(std, 6).alias("same_hour_std"), "sample_count", F.round(z, 4).alias("same_hour_zscore"))


def same_hour_join(long: DataFrame) -> DataFrame:
    """Seasonal baseline by a self-join: same weekday and hour, the 28 days before."""
    keyed = long.select("metric_name", "hour_ts", "metric_value", F.dayofweek("hour_ts").alias("dow"), F.hour("hour_ts").alias("hod"))
    a, b = keyed.alias("a"), keyed.alias("b")
    band = (F.col("b.hour_ts") >= F.col("a.hour_ts") - hours(28 * 24)) & (F.col("b.hour_ts") < F.col("a.hour_ts"))
    same = (F.col("a.metric_name") == F.col("b.metric_name")) & (F.col("a.dow") == F.col("b.dow")) & (F.col("a.hod") == F.col("b.hod")) & band
    v = F.col("b.metric_value")
    sums = a.join(b, same, "left").groupBy(F.col("a.metric_name").alias("metric_name"), F.col("a.hour_ts").alias("current_hour"), F.col("a.metric_value").alias("current_value")).agg(F.avg(v).alias("same_hour_mean"), F.stddev_samp(v).alias("same_hour_std"), F.count(v).alias("sample_count"))
    return _seasonal(sums)


def same_hour_window(long: DataFrame) -> DataFrame:
    """The same by a range frame: linear after one sort."""
    keyed = long.withColumns({"dow": F.dayofweek("hour_ts"), "hod": F.hour("hour_ts")})
    span = Window.partitionBy("metric_name", "dow", "hod").orderBy(epoch("hour_ts")).rangeBetween(-28 * 86400, -1)
    v = F.col("metric_value")
    return _seasonal(keyed.select("metric_name", F.col("hour_ts").alias("current_hour"), v.alias("current_value"), F.avg(v).over(span).alias("same_hour_mean"), F.stddev_samp(v).over(span).alias("same_hour_std"), F.count(v).over(span).alias("sample_count")))
