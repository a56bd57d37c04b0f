"""Settings of detection, baselines, alerting and retention; defaults are the thresholds that the detectors are specified with."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timedelta


@dataclass(frozen=True)
class DetectionConfig:
    baseline_hours: int = 168
    min_samples: int = 24
    baseline_end: str = "window_end"  # or window_start: leave the tested window out of its own baseline
    z_info: float = 1.5
    z_warning: float = 2.0
    z_critical: float = 3.0
    iqr_multiplier: float = 1.5
    iqr_severe: float = 3.0
    # rules
    missing_baseline: float = 5
    funnel_success: float = 10
    funnel_complete: float = 20
    funnel_share: float = 0.5
    gateway_initiated: float = 10
    gateway_hour_initiated: float = 5
    gateway_warning: float = 0.7
    gateway_critical: float = 0.5
    traffic_users: float = 10
    traffic_drop: float = 0.5
    traffic_critical: float = 0.3
    revenue_baseline: float = 100
    revenue_share: float = 0.1
    # rollup
    severity_mode: str = "rank"  # or lexicographic: the largest word
    honour_pattern_severity: bool = False
    match_hours: int = 24


@dataclass(frozen=True)
class AlertConfig:
    cooldown_hours: float = 4
    auto_resolve_hours: float = 24
    grouping: bool = True
    min_interval_seconds: float = 300
    max_incidents: int = 5
    include_hints: bool = True
    include_link: bool = True
    max_run_gap_minutes: float = 30
    routing: dict = field(default_factory=lambda: {
        "critical": {"webhook_env": "ALERT_WEBHOOK_CRITICAL", "channel": "#revenue-alerts", "mention": "@here", "also_default": True},
        "warning": {"webhook_env": "ALERT_WEBHOOK_WARNING", "channel": "#data-quality", "mention": "", "also_default": False},
        "info": {"webhook_env": "", "channel": "", "mention": "", "also_default": True},
    })
    default_webhook_env: str = "ALERT_WEBHOOK"


@dataclass(frozen=True)
class RetentionConfig:
    anomalies_days: int = 30
    baselines_days: int = 14
    runs_days: int = 90


@dataclass(frozen=True)
class Window:
    """A half-open span of time [start, end)."""

    start: datetime
    end: datetime

    @classmethod
    def resolve(cls, as_of: datetime, start: datetime | None = None, end: datetime | None = None, hours: int = 1) -> Window:
        """Defaults: the end is the hour that as_of is in, the start so many hours earlier."""
        end = end or as_of.replace(minute=0, second=0, microsecond=0)
        return cls(start or end - timedelta(hours=hours), end)


def load(path: str | None = None) -> tuple[DetectionConfig, AlertConfig, RetentionConfig]:
    """Settings from a YAML or JSON file with sections detection, alerts and retention; what it leaves out keeps its default."""
    found: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            found = yaml.safe_load(text) or {}
        except ImportError:
            import json

            found = json.loads(text)
    known = lambda kind, section: replace(kind(), **{k: v for k, v in (found.get(section) or {}).items() if k in {f.name for f in fields(kind)}})
    return known(DetectionConfig, "detection"), known(AlertConfig, "alerts"), known(RetentionConfig, "retention")
