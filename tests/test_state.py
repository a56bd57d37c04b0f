"""The state of a monitor: commits are whole or absent, reruns replace, of two writers one fails."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.config import Window
from millrace.operators import lifecycle
from millrace.plans import pipeline, state
from millrace.plans.state import Conflict, State
from millrace.schema import INCIDENTS
from millrace.sources import synthetic

END = datetime(2024, 3, 31)
AS_OF = datetime(2024, 3, 30, 19, 20)
WINDOW = Window(datetime(2024, 3, 30, 18), datetime(2024, 3, 30, 19))


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    synthetic.generate(spark, END, days=9, sessions=40).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def quick(spark, events, monkeypatch, whole):
    """Runs find what one real run found, whatever their window; storing is as it is."""
    monkeypatch.setattr(pipeline, "run", lambda events, window, as_of, *a: pipeline.Result(pipeline.run_id_of(window, as_of), whole.baselines, whole.anomalies.withColumns({"run_id": F.lit(pipeline.run_id_of(window, as_of)), "detected_at": F.lit(as_of).cast("timestamp_ntz")})))


@pytest.fixture(scope="module")
def whole(spark, events):
    found = pipeline.run(events, WINDOW, AS_OF)
    found.anomalies, found.baselines = state.kept(found.anomalies), state.kept(found.baselines)
    return found


def content(store):
    """All tables as sorted rows, without what the clock decides."""
    drop = {"runs": ["ended_at"]}
    return {n: sorted(map(str, store.read(n).drop(*drop.get(n, [])).collect())) for n in state.SCHEMAS}


def incidents(spark, *keys):
    row = lambda k: (k, AS_OF, AS_OF, "m", "warning", 1, 1.0, None, None, None, None, None, None, False, None, None, None)
    return spark.createDataFrame([row(k) for k in keys], INCIDENTS)


def test_a_rerun_replaces_its_rows(spark, events, tmp_path):
    store = State(spark, str(tmp_path / "s"))
    _, first = state.run(store, events, WINDOW, AS_OF)
    once = content(store)
    _, second = state.run(store, events, WINDOW, AS_OF)
    assert first["total_anomalies"] == second["total_anomalies"] == len(once["anomalies"]) > 0 and first["new_incidents"] == second["new_incidents"]
    assert content(store) == once and store.read("runs").count() == 1
    ids = store.read("anomalies").select("anomaly_id")
    assert ids.where("anomaly_id is null").count() == 0 and ids.distinct().count() == ids.count()
    late = events.where(F.col("event_type") != "purchase")  # other events, the same run
    state.run(store, late, WINDOW, AS_OF)
    fresh = State(spark, str(tmp_path / "t"))
    state.run(fresh, late, WINDOW, AS_OF)
    assert content(store) == content(fresh)


def test_a_rerun_after_other_changes_counts_nothing_twice(spark, events, tmp_path, quick):
    store = State(spark, str(tmp_path / "s"))
    state.run(store, events, WINDOW, AS_OF)
    later = Window(WINDOW.end, WINDOW.end + timedelta(hours=1))
    state.run(store, events, later, AS_OF + timedelta(hours=1))
    key = store.read("incidents").orderBy("incident_key").first()["incident_key"]
    store.again(lambda base: {"swap": {"incidents": lifecycle.mark(store.read("incidents", base), [key], AS_OF, "suppressed", "by hand")}})
    before = content(store)
    state.run(store, events, later, AS_OF + timedelta(hours=1))
    assert content(store) == before and store.read("incidents").where("is_suppressed").count() == 1


@pytest.mark.parametrize("step", range(7))
def test_a_run_that_dies_anywhere_leaves_all_or_nothing(spark, events, tmp_path, monkeypatch, quick, step):
    """Killed before the nth write or the taking of the manifest (no failure is recorded either: the driver is gone); then run again."""
    store = State(spark, str(tmp_path / "s"))
    state.run(store, events, Window(WINDOW.start - timedelta(hours=1), WINDOW.start), AS_OF - timedelta(hours=1))
    before, fresh = content(store), State(spark, str(tmp_path / "t"))
    for window, at in ((Window(WINDOW.start - timedelta(hours=1), WINDOW.start), AS_OF - timedelta(hours=1)), (WINDOW, AS_OF)):
        state.run(fresh, events, window, at)
    left = [step]

    def dies(f):
        def wrapped(*a, **k):
            if not left[0]:
                raise KeyboardInterrupt
            left[0] -= 1
            return f(*a, **k)

        return wrapped

    with monkeypatch.context() as m:
        m.setattr(State, "_written", dies(State._written))
        m.setattr(State, "_publish", dies(State._publish))
        if step < 5:
            with pytest.raises(KeyboardInterrupt):
                state.run(store, events, WINDOW, AS_OF)
            assert content(store) == before
        else:
            state.run(store, events, WINDOW, AS_OF)
    state.run(store, events, WINDOW, AS_OF)
    assert content(store) == content(fresh)
    assert store.vacuum(timedelta(0), datetime.now() + timedelta(days=1)) >= (step if step < 5 else 0) and content(store) == content(fresh)


def test_of_two_writers_one_fails_and_loses_nothing(spark, tmp_path):
    store = State(spark, str(tmp_path / "s"))
    store.swap("incidents", incidents(spark, "a"))
    base = store.snapshot()
    store.commit(base, add={"incidents": incidents(spark, "b")})
    with pytest.raises(Conflict):
        store.commit(base, add={"incidents": incidents(spark, "c")})
    assert sorted(r[0] for r in store.read("incidents").collect()) == ["a", "b"]
    assert [r[0] for r in store.read("incidents", base).collect()] == ["a"]  # who read before still reads that
    seen = []

    def change(now):
        if not seen:
            store.append("incidents", incidents(spark, "d"))
        seen.append(now.version)
        return {"add": {"incidents": incidents(spark, "c")}}

    store.again(change)
    assert sorted(r[0] for r in store.read("incidents").collect()) == ["a", "b", "c", "d"] and len(seen) == 2
    assert not list(Path(tmp_path).rglob("*.draft"))


def test_a_run_merges_with_what_another_writer_left(spark, events, tmp_path, monkeypatch, quick):
    store = State(spark, str(tmp_path / "s"))
    plain, first = pipeline.rolled, [True]

    def rolled(*a, **k):
        if first.pop() if first else False:
            store.append("incidents", incidents(spark, "another"))
        return plain(*a, **k)

    state.run(store, events, Window(WINDOW.start - timedelta(hours=3), WINDOW.start), AS_OF - timedelta(hours=2))
    with monkeypatch.context() as m:
        m.setattr(pipeline, "rolled", lambda *a, **k: rolled(*a, **k))
        found, _ = state.run(store, events, WINDOW, AS_OF)
    keys = {r["incident_key"] for r in store.read("incidents").collect()}
    assert "another" in keys and {r["incident_key"] for r in found.incidents.collect()} == keys


def test_folders_of_runs_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FAN", 3)
    store = State(spark, str(tmp_path / "s"))
    row = lambda k: spark.createDataFrame([(f"r{k}", AS_OF, AS_OF, AS_OF, AS_OF, "completed", 168, 18, k, None)], "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz, window_start timestamp_ntz, window_end timestamp_ntz, status string, baseline_periods int, metrics_computed int, anomalies_detected int, error_message string")
    for k in range(10):
        store.again(lambda _, k=k: {"add": {"runs": row(k)}, "run_id": f"r{k}"})
    assert len(store.snapshot().tables["runs"]) <= 3 and {r["anomalies_detected"] for r in store.read("runs").collect()} == set(range(10))
    store.again(lambda _: {"add": {"runs": row(1).withColumn("anomalies_detected", F.lit(99))}, "run_id": "r1"})  # it lies in a folder of many runs
    assert sorted(r["anomalies_detected"] for r in store.read("runs").collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 99]


def test_a_folder_without_manifest_is_taken_over(spark, tmp_path):
    incidents(spark, "old").write.parquet(str(tmp_path / "s/incidents"))
    (tmp_path / "s/incidents").rename(tmp_path / "s/incidents.last-1")  # what a crash within a swap leaves
    store = State(spark, str(tmp_path / "s"))
    assert [r[0] for r in store.read("incidents").collect()] == ["old"] and store.read("runs").count() == 0
    store.append("incidents", incidents(spark, "new"))
    assert sorted(r[0] for r in State(spark, str(tmp_path / "s")).read("incidents").collect()) == ["new", "old"]


def test_retention_reads_each_table_once(spark, events, tmp_path, quick):
    store = State(spark, str(tmp_path / "s"))
    assert state.retain(store, AS_OF) == {"deleted_anomalies": 0, "deleted_baselines": 0, "deleted_runs": 0}
    _, told = state.run(store, events, WINDOW, AS_OF)
    n = store.read("baselines").count()
    assert state.retain(store, AS_OF + timedelta(days=1)) == {"deleted_anomalies": 0, "deleted_baselines": 0, "deleted_runs": 0}
    assert state.retain(store, AS_OF + timedelta(days=200)) == {"deleted_anomalies": told["total_anomalies"], "deleted_baselines": n, "deleted_runs": 1}
    assert store.read("anomalies").count() == store.read("runs").count() == store.read("baselines").count() == 0 and store.read("incidents").count() > 0
