"""State of a monitor in one folder: runs, anomalies, baselines and incidents, as of one commit.

Data are Parquet folders that never change. A manifest, a numbered file, names the folders that make up each table; the newest one is the state. A commit writes new folders first and then its manifest, which is taken only if no other
writer has taken that number: a reader sees all of a commit or none, whatever dies where, and of two writers from the same state one gets ``Conflict`` and nothing of it is seen. A run's rows of a table are a folder
of their own, so a rerun replaces them; folders of many runs are merged, ``FAN`` of a level into one of the next. What no manifest names is left over from writers that died; ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AlertConfig, DetectionConfig, RetentionConfig, Window
from ..logs import LOG
from ..operators import lifecycle, statistical
from ..schema import ANOMALIES, BASELINES, INCIDENTS, RUNS
from ..sources import sinks
from ..sources.tables import kept
from . import pipeline

SCHEMAS = {"runs": RUNS, "anomalies": "anomaly_id string, " + ANOMALIES, "baselines": "run_id string, " + BASELINES, "incidents": INCIDENTS}
#: Folders of a level that are merged into one; manifests that stay readable for readers that began earlier.
FAN, READABLE = 16, 20


class Conflict(RuntimeError):
    """Another writer has committed since this one read the state."""


@dataclass(frozen=True)
class Snapshot:
    """The state as of a commit. tables: folders of each, as {path, run_id (None: rows of many runs), level}; before: the incidents that the last run found, while nobody has changed them since."""

    version: int
    tables: dict
    before: dict | None = None


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, store = self._at("_log")
        found = store.listStatus(folder) if store.exists(folder) else []
        return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in found) if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest commit, or an older one that is still readable."""
        numbers = self.versions()
        if not numbers and version in (None, 0):
            return Snapshot(0, self._plain_folders())
        number = numbers[-1] if version is None else version
        place, store = self._at(f"_log/{number:020d}.json")
        stream = store.open(place)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Snapshot(number, **json.loads(text))

    def _plain_folders(self) -> dict:
        """Tables of a folder that has no manifest: one folder of each name, put back first if a swap died on it."""
        out = {}
        for name in SCHEMAS:
            sinks.recover(self.spark, f"{self.path}/{name}")
            place, store = self._at(name)
            out[name] = [{"path": name, "run_id": None, "level": 99}] if store.exists(place) else []
        return out

    def _frame(self, name: str, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{f['path']}" for f in folders])

    def read(self, name: str, of: Snapshot | None = None) -> DataFrame:
        """The table, of the newest commit if not said otherwise; empty before anything was written."""
        return self._frame(name, (of or self.snapshot()).tables[name])

    def _written(self, name: str, df: DataFrame, run_id: str | None, level: int = 0) -> dict:
        kinds = dict(self.spark.createDataFrame([], SCHEMAS[name]).dtypes)
        path = f"data/{name}-{uuid.uuid4().hex}"
        df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).write.parquet(f"{self.path}/{path}")
        return {"path": path, "run_id": run_id, "level": level}

    def _publish(self, version: int, text: str) -> None:
        """The manifest under its number, whole or not at all, and never over another one."""
        final, store = self._at(f"_log/{version:020d}.json")
        draft, _ = self._at(f"_log/{uuid.uuid4().hex}.draft")
        out = store.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if store.getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(final), local(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            if store.exists(final):
                raise Conflict(f"version {version} of {self.path} is another writer's") from e
            raise
        finally:
            if store.exists(draft):
                store.delete(draft, False)

    def commit(self, base: Snapshot, add: dict[str, DataFrame] | None = None, swap: dict[str, DataFrame] | None = None, run_id: str | None = None) -> Snapshot:
        """The state after base with rows added and tables replaced, all at once. With a run_id, added rows take the place of those that the run has, and the incidents of base are remembered for its rerun.

        Raises Conflict if base isn't the newest state any more."""
        tables = {n: list(f) for n, f in base.tables.items()}
        for name, df in (swap or {}).items():
            tables[name] = [self._written(name, df, None, 99)]
        for name, df in (add or {}).items():
            if run_id is not None:
                tables[name] = self._without(name, tables[name], run_id)
            tables[name].append(self._written(name, df, run_id))
        before = base.before
        if swap and "incidents" in swap:
            same = base.before and run_id is not None and base.before["run_id"] == run_id
            before = None if run_id is None else base.before if same else {"run_id": run_id, "incidents": base.tables["incidents"]}
        tables = {n: self._merged(n, f) for n, f in tables.items()}
        new = Snapshot(base.version + 1, tables, before)
        self._publish(new.version, json.dumps({"tables": tables, "before": before}))
        return new

    def _without(self, name: str, folders: list[dict], run_id: str) -> list[dict]:
        """folders without a run's rows: its own folder goes, one of many runs that has some is written anew."""
        out = []
        for f in folders:
            if f["run_id"] == run_id:
                continue
            rows = self._frame(name, [f])
            if f["run_id"] is None and not rows.where(F.col("run_id") == run_id).isEmpty():
                f = self._written(name, rows.where(~F.col("run_id").eqNullSafe(run_id)), None, f["level"])
            out.append(f)
        return out

    def _merged(self, name: str, folders: list[dict]) -> list[dict]:
        for level in range(8):
            own = [f for f in folders if f["level"] == level]
            if len(own) >= FAN:
                one = self._written(name, self._frame(name, own).coalesce(1) if level == 0 else self._frame(name, own), None, level + 1)
                folders = [f for f in folders if f["level"] != level] + [one]
        return folders

    def again(self, change, tries: int = 5) -> Snapshot:
        """change(snapshot) -> arguments of ``commit``, made anew on the newest state where another writer was faster."""
        for k in range(tries):
            base = self.snapshot()
            try:
                return self.commit(base, **change(base))
            except Conflict:
                if k == tries - 1:
                    raise
                LOG.info("another writer was faster, once more")
        raise AssertionError

    def append(self, name: str, df: DataFrame) -> None:
        self.again(lambda _: {"add": {name: df}})

    def swap(self, name: str, df: DataFrame) -> None:
        """Replace a table; for contents that were computed from the state, use ``again``."""
        self.again(lambda _: {"swap": {name: df}})

    def reset(self) -> None:
        """Empty every table."""
        self.again(lambda _: {"swap": {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}})

    def vacuum(self, older: timedelta = timedelta(days=1), now: datetime | None = None) -> int:
        """Delete old manifests but the last READABLE, and folders that none of those names and that were last changed so long ago; how many folders went."""
        numbers = self.versions()
        _, store = self._at("_log")
        for n in numbers[:-READABLE]:
            store.delete(self._at(f"_log/{n:020d}.json")[0], False)
        known = set()
        for n in numbers[-READABLE:]:
            snap = self.snapshot(n)
            known |= {f["path"] for own in snap.tables.values() for f in own} | {f["path"] for f in (snap.before or {}).get("incidents", [])}
        folder, _ = self._at("data")
        limit = ((now or datetime.now()) - older).timestamp() * 1000
        gone = 0
        for f in store.listStatus(folder) if store.exists(folder) else []:
            if f"data/{f.getPath().getName()}" not in known and f.getModificationTime() <= limit:
                gone += bool(store.delete(f.getPath(), True))
        return gone


def run(state: State, events: DataFrame, window: Window, as_of: datetime, cfg: DetectionConfig = DetectionConfig(), clock=datetime.now, patterns: DataFrame | None = None) -> tuple[pipeline.Result, dict]:
    """A detection run over the stored state: its anomalies, baselines, incidents and its row in the run log are one commit; a run of the same run_id is replaced. Where it fails, its row alone is stored and the error is raised again.

    Where another writer commits in between, incidents are merged anew with what that writer left; anomalies don't depend on the state. A rerun merges with the incidents that the run found, unless they were changed since;
    then an incident that the run has already counted isn't counted again."""
    began = clock()
    took = lambda: as_of + (clock() - began)
    run_id = pipeline.run_id_of(window, as_of)
    try:
        found = pipeline.run(events, window, as_of, None, cfg)
        found.anomalies, found.baselines = kept(found.anomalies), kept(found.baselines)
        told = {}

        def change(base: Snapshot) -> dict:
            again = base.before and base.before["run_id"] == run_id
            open_ = state._frame("incidents", base.before["incidents"]) if again else state.read("incidents", base)
            seen = not again and not state.read("runs", base).where((F.col("run_id") == run_id) & (F.col("status") == "completed")).isEmpty()
            result = pipeline.rolled(found, as_of, open_, cfg, seen, patterns)
            result.incidents = kept(result.incidents)
            summary = result.summary.first().asDict() | {"new_incidents": result.incidents.where("is_new").count(), "duration_seconds": (took() - as_of).total_seconds()}
            told.update(result=result, summary=summary)
            log = pipeline.run_record(events, result, window, as_of, took(), cfg=cfg)
            return {"add": {"anomalies": result.anomalies.withColumn("anomaly_id", statistical.identity(F.col("run_id"))), "baselines": result.baselines.withColumn("run_id", F.lit(run_id)), "runs": log}, "swap": {"incidents": result.incidents.drop("is_new")}, "run_id": run_id}

        state.again(change)
        LOG.info("run %s: %s anomalies, %s new incidents", run_id, told["summary"]["total_anomalies"], told["summary"]["new_incidents"])
        return told["result"], told["summary"]
    except Exception as e:
        LOG.error("run of %s failed: %s", window, e)
        failed = pipeline.run_record(events, None, window, as_of, took(), error=f"{type(e).__name__}: {e}"[:1000], cfg=cfg)
        state.again(lambda _: {"add": {"runs": failed}, "run_id": run_id})
        raise


def alert(state: State, run_id: str, as_of: datetime, router: sinks.Router, cfg: AlertConfig = AlertConfig(), link: str | None = None) -> dict:
    """Route the open incidents that nothing suppresses, worst first, and mark those sent that a channel took: their cooldown starts."""
    incidents = state.read("incidents")
    open_ = incidents.where(F.col("resolved_at").isNull() & (F.col("last_detected_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")))
    send, held = lifecycle.alertable(lifecycle.suppression(open_, incidents, as_of, cfg))
    per = {r["severity"]: r["count"] for r in send.groupBy("severity").count().collect()}
    suppressed = held.count()
    first = [r.asDict() for r in lifecycle.worst_first(send).limit(cfg.max_incidents).collect()]
    took = router.route(run_id, first, link, per)
    if any(took.values()):
        channel, keys = next(c for c, ok in took.items() if ok), kept(send.select("incident_key"))
        state.again(lambda base: {"swap": {"incidents": lifecycle.mark_all(state.read("incidents", base), keys, as_of, channel)}})
    return {"alerted": sum(per.values()) if any(took.values()) else 0, "suppressed": suppressed, "channels": took}


def retain(state: State, as_of: datetime, cfg: RetentionConfig = RetentionConfig()) -> dict:
    """Apply retention to the stored tables, in one commit; how many rows went. Each table is read once: its rows are counted as they are written."""
    counts: dict = {}

    def change(base: Snapshot) -> dict:
        left, new = lifecycle.observed_retention(state.read("anomalies", base), state.read("runs", base), state.read("baselines", base), as_of, cfg)
        counts.clear()
        counts.update(new)
        return {"swap": left}

    state.again(change)
    return {name: count() for name, count in counts.items()}
