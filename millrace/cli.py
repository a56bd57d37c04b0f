"""Command line: runs, reports, alerts, suppression, health, replays, retention, validation, and synthetic events."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Window, load
from .functions import sql_surface
from .logs import LOG, setup
from .operators import health, lifecycle, rollup
from .plans import backtest, state
from .schema import INCIDENTS, RUNS
from .sources import sinks, synthetic

time_of = datetime.fromisoformat


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--config", help="YAML or JSON file of settings")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *positional: str, as_of: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        for x in positional:
            c.add_argument(x)
        if as_of:
            c.add_argument("--as-of", type=time_of, required=True, help="the time that stands for now")
        return c

    run = command("run", "detect in a window of canonical events, over the stored state", "events", "state")
    run.add_argument("--window-hours", type=int, default=1)
    run.add_argument("--patterns", help="root-cause patterns as JSON lines, in place of the built-in ones")
    for x in ("json", "markdown", "csv", "metrics", "metrics-csv"):
        run.add_argument(f"--{x}", help="write the outcome here")
    report = command("report", "tell of a stored run", "state")
    report.add_argument("--run-id"), report.add_argument("--json"), report.add_argument("--preview", action="store_true", help="print the message instead of the text"), report.add_argument("--link")
    route = command("route", "send alerts of open incidents and mark them sent", "state")
    route.add_argument("--link")
    send = command("send", "post one message to the default webhook", "text", as_of=False)
    send.add_argument("--recovered", action="store_true", help="the text is the status that the monitor has again")
    quiet = command("suppress", "suppression of stored incidents", "state")
    for x in ("stats", "auto-resolve", "show-suppressed"):
        quiet.add_argument(f"--{x}", action="store_true")
    quiet.add_argument("--mute", nargs="*", metavar="KEY"), quiet.add_argument("--unmute", nargs="*", metavar="KEY"), quiet.add_argument("--reason", default="muted by hand")
    command("retain", "delete old rows of the state, by the settings' ages", "state")
    command("reset", "empty the state tables", "state", as_of=False)
    clean = command("vacuum", "delete folders of the state that no commit names", "state", as_of=False)
    clean.add_argument("--hours", type=float, default=24.0, help="only those last changed so long ago")
    check = command("validate", "register the SQL surface and check that all of it is there", "events")
    check.add_argument("--sql", help="folder of .sql files to run first, by name")
    replay = command("backtest", "replay every hour and compare with known faults", "events", as_of=False)
    replay.add_argument("--output")
    well = command("health", "status of events, runs and incidents", "events")
    well.add_argument("--runs"), well.add_argument("--incidents"), well.add_argument("--state")
    seed = command("seed", "write a synthetic month", "path", as_of=False)
    seed.add_argument("--end", type=time_of, required=True), seed.add_argument("--days", type=int, default=30), seed.add_argument("--sessions", type=int, default=100), seed.add_argument("--seed", type=int, default=42)
    return p


def _write(path: str | None, text: str) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _run(args, spark: SparkSession, cfg) -> int:
    store = state.State(spark, args.state)
    window = Window.resolve(args.as_of, hours=args.window_hours)
    patterns = spark.read.schema(rollup.PATTERN).json(args.patterns) if args.patterns else None
    result, summary = state.run(store, spark.read.parquet(args.events), window, args.as_of, cfg, patterns=patterns)
    if args.json:
        sinks.run_json(summary, result.anomalies, result.incidents, args.json)
    if args.markdown:
        _write(args.markdown, sinks.markdown(summary, result.anomalies, result.incidents))
    if args.csv:
        sinks.incidents_csv(result.incidents, args.csv)
    if args.metrics:
        sinks.metrics_text(summary, args.metrics)
    if args.metrics_csv:
        sinks.metrics_csv(result.anomalies.withColumnsRenamed({"metric_timestamp": "hour_ts", "current_value": "metric_value", "pct_change": "pct_change_from_mean"}), args.metrics_csv)
    print(json.dumps(summary))
    return 0


def _report(args, spark: SparkSession) -> int:
    store = state.State(spark, args.state)
    runs = store.read("runs").where(F.col("status") == "completed")
    one = (runs.where(F.col("run_id") == args.run_id) if args.run_id else runs).orderBy(F.desc("started_at")).first()
    if one is None:
        print("no such run")
        return 1
    anomalies = store.read("anomalies").where(F.col("run_id") == one["run_id"])
    incidents = store.read("incidents").where(F.col("resolved_at").isNull())
    summary = {"run_id": one["run_id"], "status": one["status"], "total_anomalies": one["anomalies_detected"], "duration_seconds": (one["ended_at"] - one["started_at"]).total_seconds() if one["ended_at"] else None}
    if args.json:
        sinks.run_json(summary, anomalies, incidents, args.json)
    first = [r.asDict() for r in lifecycle.worst_first(incidents).limit(5).collect()]
    print(json.dumps(sinks.report_message(one["run_id"], first, args.as_of.isoformat(), args.link), default=str) if args.preview else sinks.markdown(summary, anomalies, incidents))
    return 0


def _suppress(args, spark: SparkSession, alerts) -> int:
    store = state.State(spark, args.state)

    def change(base) -> dict:
        incidents = store.read("incidents", base)
        for keys, what, note in ((args.mute, "suppressed", args.reason), (args.unmute, "unsuppressed", None)):
            if keys:
                incidents = lifecycle.mark(incidents, keys, args.as_of, what, note)
        return {"swap": {"incidents": lifecycle.resolve_stale(incidents, args.as_of, alerts.auto_resolve_hours) if args.auto_resolve else incidents}}

    if args.mute or args.unmute or args.auto_resolve:
        store.again(change)
    incidents = store.read("incidents")
    if args.show_suppressed:
        held = lifecycle.worst_first(incidents.where(F.col("is_suppressed") & F.col("resolved_at").isNull())).select("incident_key", "severity", "suppression_reason")
        for r in held.toLocalIterator():  # all of them, a partition at a time
            print(json.dumps(r.asDict()))
    if args.stats or args.auto_resolve:
        print(json.dumps(lifecycle.suppression_stats(incidents, args.as_of).first().asDict()))
    return 0


def _table(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    return spark.read.parquet(path) if path else spark.createDataFrame([], schema)


def _health(args, spark: SparkSession, alerts) -> int:
    store = state.State(spark, args.state) if args.state else None
    runs = store.read("runs") if store else _table(spark, args.runs, RUNS)
    incidents = store.read("incidents") if store else _table(spark, args.incidents, INCIDENTS)
    status = health.report(spark.read.parquet(args.events), runs, incidents, args.as_of, alerts.max_run_gap_minutes)
    print(json.dumps(status, default=str))
    return 0 if status["overall_status"] == "healthy" else 1


def _backtest(args, spark: SparkSession, cfg) -> int:
    events = spark.read.parquet(args.events)
    _, scored = backtest.evaluate(backtest.replay(events, cfg), backtest.known_windows(events))
    text = json.dumps(scored.first().asDict())
    _write(args.output, text)
    print(text)
    return 0


def _validate(args, spark: SparkSession) -> int:
    sql_surface.register(spark, spark.read.parquet(args.events), args.as_of)
    ran = sql_surface.run_files(spark, args.sql) if args.sql else []
    lost = sql_surface.missing(spark)
    print(json.dumps({"files": ran, "missing": lost}))
    return 1 if lost else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, send=sinks.deliver, env: dict | None = None) -> int:
    args = parser().parse_args(argv)
    setup()
    cfg, alerts, keep = load(args.config)
    env = dict(os.environ) if env is None else env
    if args.command == "send":
        url = env.get(alerts.default_webhook_env)
        payload = sinks.recovery_message({"overall_status": args.text}) if args.recovered else sinks.simple_message(args.text)
        ok = bool(url) and send(payload, url)
        LOG.info("message %s", "sent" if ok else "not sent")
        return 0 if ok else 1
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        if args.command == "run":
            return _run(args, spark, cfg)
        if args.command == "report":
            return _report(args, spark)
        if args.command == "route":
            store = state.State(spark, args.state)
            run = store.read("runs").orderBy(F.desc("started_at")).first()
            print(json.dumps(state.alert(store, run["run_id"] if run else "", args.as_of, sinks.Router(alerts, send, env), alerts, args.link)))
            return 0
        if args.command == "suppress":
            return _suppress(args, spark, alerts)
        if args.command == "retain":
            print(json.dumps(state.retain(state.State(spark, args.state), args.as_of, keep)))
            return 0
        if args.command == "reset":
            state.State(spark, args.state).reset()
            return 0
        if args.command == "vacuum":
            print(json.dumps({"deleted_folders": state.State(spark, args.state).vacuum(timedelta(hours=args.hours))}))
            return 0
        if args.command == "validate":
            return _validate(args, spark)
        if args.command == "backtest":
            return _backtest(args, spark, cfg)
        if args.command == "health":
            return _health(args, spark, alerts)
        sinks.write_events(synthetic.generate(spark, args.end, args.days, args.sessions, args.seed), args.path)
        return 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


if __name__ == "__main__":
    sys.exit(main())
