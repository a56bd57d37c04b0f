"""Sinks, routing, the generator, the SQL surface, streams and the command line."""

import json
import logging
import os
from datetime import datetime, timedelta

import pytest

from millrace import __version__, cli, logs
from millrace.config import Window, load
from millrace.functions import sql_surface
from millrace.plans import backtest, pipeline
from millrace.plans.state import State
from millrace.sources import sinks, synthetic
from millrace.streaming import hourly

from .conftest import DATA

END = datetime(2024, 3, 31)
INCIDENT = {"metric_name": "m", "severity": "critical", "current_value": 1.0, "baseline_value": None, "deviation_pct": None, "root_cause_hint": "look"}


def test_delivery_retries_what_may_pass():
    waits, answers = [], iter([(429, {"Retry-After": "7"}), (503, {}), (200, {})])
    assert sinks.deliver({}, "u", lambda p, u: next(answers), sleep=waits.append) and waits == [7.0, 2.0]
    assert not sinks.deliver({}, "u", lambda p, u: (404, {}), sleep=waits.append)
    assert not sinks.deliver({}, "u", lambda p, u: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)


def test_router_limits_its_rate():
    sent, now = [], [0.0]
    r = sinks.Router(send=lambda p, u: sent.append(u) or True, env={"ALERT_WEBHOOK_CRITICAL": "c", "ALERT_WEBHOOK": "d"}, clock=lambda: now[0])
    assert r.route("r", [INCIDENT]) == {"#revenue-alerts": True, "default": True} and sent == ["c", "d"]
    now[0] = 299
    assert r.route("r", [INCIDENT]) == {"#revenue-alerts": False, "default": False}
    now[0] = 301
    assert all(r.route("r", [INCIDENT]).values()) and r.route("r", []) == {}


def test_alert_renders_missing_figures_and_one_mention():
    text = json.dumps(sinks.alert("r", [INCIDENT] * 7))
    assert "N/A" in text and text.count("@here") == 1 and "7 critical" in text


def test_run_and_its_outputs(spark, tmp_path):
    events = synthetic.generate(spark, END, days=10, sessions=80).cache()
    result = pipeline.run(events, Window(END - timedelta(hours=6), END - timedelta(hours=5)), END)
    summary = result.summary.first().asDict()
    assert summary["total_anomalies"] > 0 and "zero_revenue_bug" in {r[0] for r in result.anomalies.select("metric_name").collect()}
    incidents = result.incidents
    assert "N/A" in sinks.markdown(summary, result.anomalies, _stated(incidents))
    assert json.loads(sinks.run_json(summary, result.anomalies, incidents))["run"]["run_id"] == result.run_id
    sinks.incidents_csv(_stated(incidents), str(tmp_path / "i"))
    assert spark.read.csv(str(tmp_path / "i"), header=True).columns == list(sinks.INCIDENT_COLUMNS)
    assert "millrace_run_total_anomalies" in sinks.metrics_text(summary, str(tmp_path / "m.prom"), 1.0)
    scored = backtest.evaluate(backtest.replay(events), backtest.known_windows(events, END))[1].first()
    assert scored["recall"] > 0


def _stated(candidates):
    from millrace.operators import rollup
    from millrace.schema import INCIDENTS

    return rollup.upsert(candidates.sparkSession.createDataFrame([], INCIDENTS), candidates, END)


def test_generator_is_the_same_however_partitioned(spark):
    a = synthetic.generate(spark, END, days=2, sessions=5)
    one = a.selectExpr("count(*) n", "bit_xor(xxhash64(event_id, event_time, user_id, event_type, amount)) h").first()
    b = synthetic.generate(spark, END, days=2, sessions=5).repartition(7)
    assert b.selectExpr("count(*) n", "bit_xor(xxhash64(event_id, event_time, user_id, event_type, amount)) h").first() == one


def test_sql_surface(spark):
    sql_surface.register(spark, synthetic.generate(spark, END, days=3, sessions=5), END)
    assert sql_surface.missing(spark) == [] and sql_surface.missing(spark, ["nope"]) == ["nope"]
    assert spark.sql("SELECT count(DISTINCT metric_name) FROM v_metrics_long").first()[0] == 18


def test_state_swaps_with_its_own_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sinks.swap(spark.read.parquet(path).selectExpr("id + 1 AS id"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_stream_of_hours(spark, tmp_path):
    from millrace.sources.adapter import canonical

    canonical(spark.read.parquet(f"{DATA}/sf0.001/events.parquet")).repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    seen = []
    hourly.each_batch(hourly.hourly_counts(stream), lambda df, k: seen.extend(df.collect()), str(tmp_path / "c")).awaitTermination()
    assert len(seen) > 100 and {"hour_ts", "event_type", "event_count"} <= set(seen[0].asDict())


def test_command_line_from_run_to_cooldown(spark, tmp_path, capsys):
    """A run, its report, a sent alert, the cooldown that the next run meets, a failed run in the log, health, retention, reset."""
    path, store, sent = str(tmp_path / "e"), str(tmp_path / "s"), []
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    call = lambda *a: cli.main([str(x) for x in a], spark, lambda payload, url: sent.append((url, payload)) or True, {"ALERT_WEBHOOK": "d", "ALERT_WEBHOOK_CRITICAL": "c"})
    assert call("seed", path, "--end", "2024-03-31", "--days", "9", "--sessions", "60") == 0
    assert call("run", path, store, "--as-of", "2024-03-30T19:20:00", "--json", tmp_path / "r.json", "--markdown", tmp_path / "r.md", "--metrics", tmp_path / "m.prom", "--metrics-csv", tmp_path / "m", "--csv", tmp_path / "i") == 0
    first = said()
    assert first["total_anomalies"] > 0 and first["new_incidents"] > 0 and first["duration_seconds"] > 0
    told = json.loads((tmp_path / "r.json").read_text())
    assert told["run"]["run_id"] == first["run_id"] and told["anomaly_count"] == first["total_anomalies"] and spark.read.csv(str(tmp_path / "m"), header=True).columns == list(sinks.METRIC_COLUMNS)
    assert call("report", store, "--as-of", "2024-03-30T19:25:00") == 0 and first["run_id"] in capsys.readouterr().out
    assert call("report", store, "--as-of", "2024-03-30T19:25:00", "--preview") == 0 and first["run_id"] in said()["text"]
    assert call("route", store, "--as-of", "2024-03-30T19:30:00") == 0
    routed = said()
    assert routed["alerted"] > 0 and routed["suppressed"] == 0 and {u for u, _ in sent} <= {"c", "d"} and sent
    assert call("run", path, store, "--as-of", "2024-03-30T19:40:00") == 0 and said()["new_incidents"] >= 0
    before = len(sent)
    assert call("route", store, "--as-of", "2024-03-30T19:50:00") == 0
    again = said()
    assert again["suppressed"] > 0 and (again["alerted"] == 0 or len(sent) > before)
    key = State(spark, store).read("incidents").first()["incident_key"]
    assert call("suppress", store, "--as-of", "2024-03-30T19:55:00", "--mute", key, "--show-suppressed", "--stats") == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert json.loads(out[0])["incident_key"] == key and json.loads(out[-1])["suppressed_count"] == 1
    assert call("suppress", store, "--as-of", "2024-04-02T00:00:00", "--unmute", key, "--auto-resolve") == 0
    assert State(spark, store).read("incidents").where("resolved_at is null").count() == 0
    spark.range(3).write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="(?i)event_time"):
        call("run", tmp_path / "wrong", store, "--as-of", "2024-03-30T20:05:00")
    log = State(spark, store).read("runs")
    assert sorted(r["status"] for r in log.collect()) == ["completed", "completed", "failed"] and log.where("status = 'failed' and error_message is not null and ended_at is not null").count() == 1
    assert call("health", path, "--state", store, "--as-of", "2024-03-30T20:00:00") == 0
    status = said()
    assert status["checks"]["connection"]["status"] == status["checks"]["recent_runs"]["status"] == "healthy" and status["checks"]["recent_runs"]["failed_count"] >= 0
    assert call("retain", store, "--as-of", "2024-05-15T00:00:00") == 0 and said()["deleted_anomalies"] >= first["total_anomalies"]
    assert call("reset", store) == 0 and State(spark, store).read("runs").count() == 0
    assert call("validate", path, "--as-of", "2024-03-31T00:00:00") == 0 and said()["missing"] == []
    assert call("send", "back") == 0 and sent[-1] == ("d", {"text": "back"}) and call("send", "healthy", "--recovered") == 0 and "again" in sent[-1][1]["text"]


def test_routines_in_sql(spark):
    sql_surface.register(spark, synthetic.generate(spark, END, days=3, sessions=5), END)
    one = spark.sql("SELECT * FROM compute_rolling_stats('page_views', TIMESTAMP_NTZ'2024-03-31 00:00:00', 168)").first()
    base = spark.sql("SELECT * FROM get_baseline_for_metric('page_views', TIMESTAMP_NTZ'2024-03-31 00:00:00')").first()
    assert one["sample_count"] == base["sample_count"] > 24 and abs(one["rolling_mean"] - base["baseline_mean"]) < 1e-5
    assert spark.sql("SELECT * FROM get_baseline_for_metric('page_views', TIMESTAMP_NTZ'2024-01-01 00:00:00')").count() == 0
    assert sql_surface.missing(spark, [], ["nope"]) == ["nope"]


def test_sql_files_run_in_order(spark, tmp_path):
    (tmp_path / "2.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW b AS SELECT x + 1 AS x FROM a;\n")
    (tmp_path / "1.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW a AS SELECT 1 AS x;\n-- a note\nSELECT 1;")
    assert sql_surface.run_files(spark, str(tmp_path)) == ["1.sql", "2.sql"] and spark.table("b").first()[0] == 2
    (tmp_path / "3.sql").write_text("SELECT * FROM nowhere")
    with pytest.raises(RuntimeError, match="statement 1"):
        sql_surface.run_files(spark, str(tmp_path))


def test_swap_survives_a_crash_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    os.rename(path, f"{path}.last-1")  # as if the driver had died there
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 3 and not sinks.recover(spark, path)
    sinks.swap(spark.range(5).toDF("id"), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_messages():
    rows = [INCIDENT | {"severity": "warning", "root_cause_hint": None}, INCIDENT]
    text = json.dumps(sinks.report_message("r1", rows, "now", "http://x"))
    assert "r1" in text and "look" in text and "N/A" in text and "http://x" in text and "CRITICAL" in text
    assert "unhealthy" in sinks.health_message({"overall_status": "unhealthy", "checks": {"a": {"status": "unhealthy"}}})["text"]
    assert "5 critical" in json.dumps(sinks.alert("r", [INCIDENT], per={"critical": 5}))


def test_log_level_and_version(monkeypatch):
    monkeypatch.setenv("LOG_LEVEL", "ERROR")
    assert logs.setup() == logging.ERROR == logging.getLogger().level
    monkeypatch.setenv("LOG_LEVEL", "no such level")
    assert logs.setup("WARNING") == logging.WARNING
    assert len(__version__.split(".")) >= 2 and all(x.isdigit() for x in __version__.split(".")[:2])


def test_settings_file(tmp_path):
    (tmp_path / "c.json").write_text('{"detection": {"z_warning": 2.5, "unknown": 1}, "retention": {"runs_days": 9}}')
    d, a, r = load(str(tmp_path / "c.json"))
    assert (d.z_warning, d.z_critical, a.cooldown_hours, r.runs_days) == (2.5, 3.0, 4, 9)
