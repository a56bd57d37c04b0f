"""Standard-score and interquartile detectors: filters and thresholds over metrics set against baselines.

A detector is a ``Hit``: a condition and what it says of a row. One or all of them go over the rows in a single pass; what several find of a row stays several anomalies.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig, Window
from ..schema import RATES, REVENUE
from .baselines import at

SHAPE = ("metric_name", "metric_timestamp", "current_value", "baseline_mean", "baseline_std", "baseline_q1", "baseline_q3", "baseline_iqr", "z_score", "iqr_distance", "pct_change", "detector", "rule", "severity", "direction", "description", "metadata_json")


def identity(run_id: Column) -> Column:
    """The id of an anomaly, the same whenever its run is run again: a digest of the run, what found it, its metric and time."""
    return F.sha2(F.concat_ws("~", run_id, "detector", "rule", "metric_name", F.date_format("metric_timestamp", "yyyy-MM-dd HH:mm:ss")), 256)


def _c(name: str) -> Column:
    return F.col(name)


def within(rows: DataFrame, window: Window | None) -> DataFrame:
    return rows if window is None else rows.where((_c("hour_ts") >= at(window.start)) & (_c("hour_ts") < at(window.end)))


def money(x: Column) -> Column:
    """Two decimals as text, halves away from zero."""
    return x.cast("decimal(24,2)").cast("string")


def sign(x: Column) -> Column:
    return F.when(x > 0, "above").when(x < 0, "below").otherwise("none")


def document(**fields: Column) -> Column:
    """A JSON document of named values; nulls are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


@dataclass(frozen=True)
class Hit:
    """detector and rule, when it fires, and the anomaly's severity, direction, distance from the fences, text and further facts."""

    detector: str
    rule: str
    when: Column
    severity: Column
    direction: Column
    text: Column
    distance: Column | None = None
    facts: dict[str, Column] = field(default_factory=dict)

    def struct(self) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            (F.round("z_score", 4) if self.detector == "zscore" else none).alias("z_score"), (F.round(self.distance, 4) if self.distance is not None else none).alias("iqr_distance"),
            F.lit(self.detector).alias("detector"), F.lit(self.rule).alias("rule"), self.severity.alias("severity"), self.direction.alias("direction"), self.text.alias("description"),
            (document(**self.facts) if self.facts else F.lit(None).cast("string")).alias("metadata_json"),
        )


def detect(rows: DataFrame, hits: list[Hit], window: Window | None = None) -> DataFrame:
    """Anomalies of all hits, one for each that fires, in one pass over rows; scores and changes keep four decimals."""
    fired = F.explode(F.array_compact(F.array(*[F.when(h.when, h.struct()) for h in hits])))
    found = within(rows, window).select(
        "metric_name", _c("hour_ts").alias("metric_timestamp"), _c("metric_value").alias("current_value"), "baseline_mean", "baseline_std", "baseline_q1", "baseline_q3", "baseline_iqr",
        F.round("pct_change_from_mean", 4).alias("pct_change"), fired.alias("hit"),
    )
    return found.select("*", "hit.*").select(*SHAPE)


def _scored(cfg: DetectionConfig) -> Column:
    return (_c("baseline_std") > 0) & (_c("baseline_sample_count") >= cfg.min_samples)


def _fenced(cfg: DetectionConfig) -> Column:
    return (_c("baseline_iqr") > 0) & (_c("baseline_sample_count") >= cfg.min_samples)


def _outside() -> Column:
    return (_c("metric_value") < _c("iqr_lower_bound")) | (_c("metric_value") > _c("iqr_upper_bound"))


def _beyond() -> Column:
    v = _c("metric_value")
    return F.when(v < _c("iqr_lower_bound"), (_c("iqr_lower_bound") - v) / _c("baseline_iqr")).when(v > _c("iqr_upper_bound"), (v - _c("iqr_upper_bound")) / _c("baseline_iqr")).otherwise(F.lit(0.0))


def _severe(cfg: DetectionConfig) -> Column:
    v = _c("metric_value")
    return F.when((v < _c("baseline_q1") - cfg.iqr_severe * _c("baseline_iqr")) | (v > _c("baseline_q3") + cfg.iqr_severe * _c("baseline_iqr")), "critical").otherwise("warning")


def _side() -> Column:
    return F.when(_c("metric_value") < _c("iqr_lower_bound"), "below").otherwise("above")


def _against_mean(what: str = "") -> Column:
    return F.concat(F.lit(what), _c("metric_name"), F.lit(" at "), money(_c("metric_value")), F.lit(", mean "), money(_c("baseline_mean")), F.lit(", z "), money(_c("z_score")))


def _against_fences(what: str = "") -> Column:
    return F.concat(F.lit(what), _c("metric_name"), F.lit(" at "), money(_c("metric_value")), F.lit(", usually "), money(_c("baseline_q1")), F.lit(" to "), money(_c("baseline_q3")))


def zscore_hits(cfg: DetectionConfig = DetectionConfig()) -> list[Hit]:
    """All metrics; revenue, whose drops count from 1.5 deviations on and are worse than rises; conversion rates."""
    z, size = _c("z_score"), F.abs("z_score")
    plain = F.when(size >= cfg.z_critical, "critical").otherwise("warning")
    core = _c("metric_name").isin([m for m in REVENUE if m != "revenue_per_session"])
    graded = F.when(core & (z <= -2.5), "critical").when(core & (z <= -1.5), "warning").when(size >= 3.0, "critical").when(size >= 2.0, "warning").otherwise("info")
    return [
        Hit("zscore", "zscore", _scored(cfg) & (size >= cfg.z_warning), plain, sign(z), _against_mean()),
        Hit("zscore", "zscore_revenue", _scored(cfg) & _c("metric_name").isin(REVENUE) & ((z <= -1.5) | (z >= 2.0)), graded, sign(z), _against_mean("revenue: "),
            facts={"metric_category": F.lit("revenue"), "impact_severity": F.lit("high"), "requires_immediate_action": z <= -2.5}),
        Hit("zscore", "zscore_conversion", _scored(cfg) & _c("metric_name").isin(RATES) & (size >= cfg.z_warning), plain, sign(z), _against_mean("conversion: "),
            facts={"metric_category": F.lit("conversion"), "baseline_rate": _c("baseline_mean"), "current_rate": _c("metric_value")}),
    ]


def iqr_hits(cfg: DetectionConfig = DetectionConfig()) -> list[Hit]:
    """All metrics outside the fences; revenue with a nearer fence below, every drop beyond it critical; the average order value next to nothing,
    three times the upper quartile, or outside the fences."""
    v, q1, q3, width, median = (_c(x) for x in ("metric_value", "baseline_q1", "baseline_q3", "baseline_iqr", "baseline_median"))
    low, nothing, spike = v < q1 - 1.0 * width, (v < 1.0) & (median > 10.0), v > q3 * 3.0
    return [
        Hit("iqr", "iqr", _fenced(cfg) & _outside(), _severe(cfg), _side(), _against_fences(), _beyond()),
        Hit("iqr", "iqr_revenue", _fenced(cfg) & _c("metric_name").isin(REVENUE) & (low | (v > q3 + 1.5 * width)), F.when(low | (v > q3 + 2.0 * width), "critical").otherwise("warning"), sign(v - median), _against_fences("revenue: "), F.abs(v - median) / width,
            {"metric_category": F.lit("revenue"), "detection_method": F.lit("iqr"), "iqr_multiplier_used": F.when(v < median, 1.0).otherwise(1.5)}),
        Hit("iqr", "aov", _fenced(cfg) & (_c("metric_name") == "avg_order_value") & (nothing | spike | _outside()), F.when(nothing | spike, "critical").otherwise("warning"), sign(v - median), _against_fences("order value: "), _beyond(),
            {"aov_baseline_median": median, "aov_current": v, "is_zero_aov": v < 1.0, "is_extreme_spike": spike}),
    ]


def zscore_view(rows: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """All hours of at least info severity, with the figures behind them."""
    size = F.abs("z_score")
    severity = F.when(size >= cfg.z_critical, "critical").when(size >= cfg.z_warning, "warning").otherwise("info")
    found = rows.where(_scored(cfg) & (size >= cfg.z_info))
    return found.select("hour_ts", "metric_name", "metric_value", "baseline_mean", "baseline_std", "z_score", "pct_change_from_mean", severity.alias("severity"), sign(_c("z_score")).alias("direction"), "baseline_sample_count")


def iqr_view(rows: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """All hours outside the fences, with the figures behind them."""
    found = rows.where(_fenced(cfg) & _outside())
    return found.select("hour_ts", "metric_name", "metric_value", "baseline_q1", "baseline_median", "baseline_q3", "baseline_iqr", "iqr_lower_bound", "iqr_upper_bound", _beyond().alias("iqr_distance"), _severe(cfg).alias("severity"), _side().alias("direction"), "baseline_sample_count")


def zscore(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, zscore_hits(cfg)[:1], window)


def zscore_revenue(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, zscore_hits(cfg)[1:2], window)


def zscore_conversion(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, zscore_hits(cfg)[2:], window)


def all_zscore(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, zscore_hits(cfg), window)


def iqr(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, iqr_hits(cfg)[:1], window)


def iqr_revenue(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, iqr_hits(cfg)[1:2], window)


def iqr_order_value(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, iqr_hits(cfg)[2:], window)


def all_iqr(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detect(rows, iqr_hits(cfg), window)


def all_statistical(rows: DataFrame, window: Window | None = None, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Both families in one pass."""
    return detect(rows, zscore_hits(cfg) + iqr_hits(cfg), window)
