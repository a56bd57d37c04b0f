"""Outputs of a run: CSV, JSON, Markdown, a metrics text file, alert payloads and their delivery."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AlertConfig
from ..schema import SEVERITIES, rank

INCIDENT_COLUMNS = ("incident_key", "metric_name", "severity", "first_detected_at", "last_detected_at", "detection_count", "current_value", "baseline_value", "deviation_pct", "root_cause_hint", "related_metrics", "is_suppressed")
METRIC_COLUMNS = ("hour_ts", "metric_name", "metric_value", "baseline_mean", "baseline_std", "z_score", "pct_change_from_mean")
COLOURS = {"critical": "#C0392B", "warning": "#E67E22", "info": "#2980B9"}


def write_events(events: DataFrame, path: str) -> None:
    """Append events, by day, so that windows read few files."""
    events.withColumn("day", F.to_date("event_time")).write.mode("append").partitionBy("day").parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Replace a state table by a snapshot that may have been read from it: written beside it, the old one renamed aside, the new one renamed in, the old one deleted.

    A crash leaves the old or the new table beside the path at worst, never neither; ``recover`` puts it back."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stamp = time.time_ns()
    names = [f"{path.rstrip('/')}.next-{stamp}", path, f"{path.rstrip('/')}.last-{stamp}"]
    df.write.parquet(names[0])
    new, now, last = (jvm.org.apache.hadoop.fs.Path(n) for n in names)
    fs = new.getFileSystem(conf)
    had = fs.exists(now)
    if had and not fs.rename(now, last):
        raise OSError(f"can't rename {path} to {names[2]}")
    if not fs.rename(new, now):
        if had:
            fs.rename(last, now)
        raise OSError(f"can't rename {names[0]} to {path}")
    if had:
        fs.delete(last, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Whether a table that a crash within ``swap`` took away was put back: the newest snapshot that was written whole, else the last one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    now = jvm.org.apache.hadoop.fs.Path(path)
    fs = now.getFileSystem(conf)
    if fs.exists(now):
        return False
    for kind in ("next", "last"):
        found = sorted((f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-*")) or []), key=lambda p: p.getName())
        whole = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if whole and fs.rename(whole[-1], now):
            return True
    return False


def incidents_csv(incidents: DataFrame, path: str) -> None:
    rows = incidents.withColumn("related_metrics", F.array_join("related_metrics", ", "))
    rows.select(*INCIDENT_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True)


def metrics_csv(rows: DataFrame, path: str) -> None:
    rows.select(*METRIC_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True)


def _plain(row) -> dict:
    return {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in row.asDict().items()}


def run_json(summary: dict, anomalies: DataFrame, incidents: DataFrame, path: str | None = None, most: int = 1000) -> str:
    """The run, its anomalies and incidents as one document: the worst ``most`` of each, and how many there are. All of them are in the state tables."""
    when = lambda df: next(c for c in ("last_detected_at", "metric_timestamp") if c in df.columns)
    shown = lambda df: [_plain(r) for r in df.orderBy(rank(F.col("severity")), F.col(when(df)).desc_nulls_last(), "metric_name").limit(most).collect()]
    found = {"run": summary, "anomaly_count": anomalies.count(), "incident_count": incidents.count(), "anomalies": shown(anomalies), "incidents": shown(incidents)}
    text = json.dumps(found, default=str, indent=1)
    if path:
        Path(path).write_text(text, encoding="utf-8")
    return text


def figure(x, unit: str = "") -> str:
    """A number for a text, N/A where there is none: rules have no baselines or changes."""
    return "N/A" if x is None else f"{x:,.2f}{unit}"


def markdown(summary: dict, anomalies: DataFrame, incidents: DataFrame, most: int = 20, listed: int = 200) -> str:
    """A report: counts, the latest critical and warning incidents, the largest anomalies."""
    per = {r["severity"]: r["count"] for r in incidents.groupBy("severity").count().collect()}
    out = [f"# Run {summary.get('run_id', '')}", "", *[f"- {k}: {v}" for k, v in summary.items() if k != "run_id"], *[f"- {s} incidents: {per.get(s, 0)}" for s in SEVERITIES], ""]
    for s in SEVERITIES[:2]:
        out += [f"## {s.capitalize()} incidents", ""]
        for r in incidents.where(F.col("severity") == s).orderBy(F.col("last_detected_at").desc_nulls_last(), "incident_key").limit(listed).collect():
            out += [f"- **{r['metric_name']}**: {figure(r['current_value'])}, usually {figure(r['baseline_value'])} ({figure(r['deviation_pct'], '%')}). {r['root_cause_hint'] or ''}"]
        out.append("")
    out += ["## Anomalies", "", "| metric | hour | value | mean | z | severity |", "|-|-|-|-|-|-|"]
    for r in anomalies.orderBy(rank(F.col("severity")), F.abs("z_score").desc_nulls_last(), "metric_name", "metric_timestamp").limit(most).collect():
        out.append(f"| {r['metric_name']} | {r['metric_timestamp']} | {figure(r['current_value'])} | {figure(r['baseline_mean'])} | {figure(r['z_score'])} | {r['severity']} |")
    return "\n".join(out) + "\n"


def metrics_text(summary: dict, path: str | None = None, now: float | None = None) -> str:
    """Gauges in the text format that scrapers read."""
    gauges = [("millrace_run_total_anomalies", "Anomalies of the last run.", int(summary.get("total_anomalies") or 0)), ("millrace_run_new_incidents", "Incidents of the last run.", int(summary.get("new_incidents") or 0)), ("millrace_run_unixtime", "When these were written.", int(time.time() if now is None else now))]
    text = "".join(f"# HELP {n} {h}\n# TYPE {n} gauge\n{n} {v}\n" for n, h, v in gauges)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def worst(incidents: list[dict]) -> str:
    return min((i.get("severity") or "info" for i in incidents), key=lambda s: SEVERITIES.index(s) if s in SEVERITIES else 3, default="info")


def alert(run_id: str, incidents: list[dict], link: str | None = None, cfg: AlertConfig = AlertConfig(), per: dict[str, int] | None = None) -> dict:
    """A message: full counts (per, where incidents are but the first), the first incidents with figures and hints, a mention if the severity has one."""
    severity = worst(incidents)
    mention = cfg.routing.get(severity, {}).get("mention", "")
    per = {s: sum(i.get("severity") == s for i in incidents) for s in SEVERITIES} if per is None else per
    counts = ", ".join(f"{n} {s}" for s in SEVERITIES if (n := per.get(s, 0)))
    section = lambda text: {"type": "section", "text": {"type": "mrkdwn", "text": text}}
    blocks = [{"type": "header", "text": {"type": "plain_text", "text": f"{severity.upper()}: {sum(per.values())} incidents"}}]
    blocks += [section(mention)] if mention else []
    blocks.append(section(f"Run `{run_id}`: {counts}"))
    for i in incidents[: cfg.max_incidents]:
        text = f"*{i.get('metric_name')}* {figure(i.get('current_value'))}, usually {figure(i.get('baseline_value'))} ({figure(i.get('deviation_pct'), '%')})"
        blocks.append(section(text + (f"\n{i['root_cause_hint']}" if cfg.include_hints and i.get("root_cause_hint") else "")))
    blocks += [section(f"<{link}|Run log>")] if link and cfg.include_link else []
    return {"text": f"{severity}: {counts or 'no incidents'}", "attachments": [{"color": COLOURS.get(severity, COLOURS["info"]), "blocks": blocks}]}


def report_message(run_id: str, incidents: list[dict], when: str, link: str | None = None, most: int = 5) -> dict:
    """The report's own payload: the run and its time, the first critical and warning incidents, what the worst one's hint says, a link."""
    order = [i for s in SEVERITIES[:2] for i in incidents if i.get("severity") == s][:most]
    severity = worst(incidents)
    section = lambda text: {"type": "section", "text": {"type": "mrkdwn", "text": text}}
    blocks = [{"type": "header", "text": {"type": "plain_text", "text": f"Report ({severity.upper()})"}}, section(f"Run `{run_id}`, {when}"), {"type": "divider"}]
    if order:
        blocks.append(section("\n".join(f"*{i['metric_name']}* {figure(i.get('current_value'))}, usually {figure(i.get('baseline_value'))} ({figure(i.get('deviation_pct'), '%')})" for i in order)))
    if told := next((i["root_cause_hint"] for i in order if i.get("root_cause_hint")), None):
        blocks += [{"type": "divider"}, section(told)]
    blocks += [section(f"<{link}|Full report>")] if link else []
    return {"text": f"Report of {run_id}: {severity}", "attachments": [{"color": COLOURS.get(severity, COLOURS["info"]), "blocks": blocks}]}


def health_message(status: dict) -> dict:
    lines = [f"{k}: {v['status']}" for k, v in status.get("checks", {}).items()]
    return {"text": f"Monitor is {status['overall_status']}\n" + "\n".join(lines)}


def recovery_message(status: dict) -> dict:
    return {"text": f"Monitor is {status.get('overall_status', 'healthy')} again"}


def simple_message(text: str) -> dict:
    return {"text": text}


def post(payload: dict, url: str, headers: dict | None = None) -> tuple[int, dict]:
    """(status, headers) of a POST of the payload."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=10) as r:
            return r.status, dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers)


def deliver(payload: dict, url: str, transport: Callable[[dict, str], tuple[int, dict]] = post, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether it was taken: 200 is; 429 waits as long as it says, faults of the server and time-outs are tried again, other refusals aren't."""
    for k in range(tries):
        try:
            status, headers = transport(payload, url)
        except (TimeoutError, OSError):
            status, headers = 599, {}
        if status == 200:
            return True
        if status != 429 and status < 500:
            return False
        if k < tries - 1:
            wait = headers.get("Retry-After") or headers.get("retry-after")
            sleep(float(wait) if status == 429 and wait else 2.0**k)
    return False


class Router:
    """Alerts to the channel of their severity and to the default one, not more often than the limit allows."""

    def __init__(self, cfg: AlertConfig = AlertConfig(), send: Callable[[dict, str], bool] = deliver, env: dict | None = None, clock: Callable[[], float] = time.monotonic):
        self.cfg, self.send, self.env, self.clock = cfg, send, os.environ if env is None else env, clock
        self.last: dict[tuple[str, str], float] = {}

    def _try(self, severity: str, channel: str, payload: dict, url: str) -> bool:
        then = self.last.get((severity, channel))
        if then is not None and self.clock() - then < self.cfg.min_interval_seconds:
            return False
        if self.send(payload, url):
            self.last[severity, channel] = self.clock()
            return True
        return False

    def route(self, run_id: str, incidents: list[dict], link: str | None = None, per: dict[str, int] | None = None) -> dict[str, bool]:
        """Whether each channel took the alert."""
        if not incidents:
            return {}
        severity = worst(incidents)
        own, out = self.cfg.routing.get(severity, {}), {}
        payload = alert(run_id, incidents, link, self.cfg, per)
        if url := self.env.get(own.get("webhook_env") or ""):
            channel = own.get("channel") or "specific"
            out[channel] = self._try(severity, channel, payload, url)
        if own.get("also_default", True) and (url := self.env.get(self.cfg.default_webhook_env)):
            out["default"] = self._try(severity, "default", payload, url)
        return out
