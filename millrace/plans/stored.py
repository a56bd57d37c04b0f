"""Hourly aggregates kept up to date in a folder: new events make their days dirty, and only those days are computed anew.

``events`` (by day, appended), ``dirty`` (a folder of hours for each arrival), ``ids`` (numbers, appended), ``sums`` and ``marks`` (by day, whole days replaced by dynamic partition overwrite). Hours are marked before their events
are written, and marks go only after the days that they name stand: whatever dies where, the next ``refresh`` computes those days again, with the same result. One refresher at a time; any number of arrivals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectionConfig, Window
from ..operators import metrics, partials, rules
from ..operators.baselines import at
from ..operators.metrics import hour_of
from ..schema import EVENTS
from ..sources.tables import kept


class Hourly:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        place, store = self._folder(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if store.exists(place) else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._read("events", EVENTS + ", day date")

    def ids(self) -> DataFrame:
        return self._read("ids", partials.IDS)

    def sums(self) -> DataFrame:
        return self._read("sums", partials.SUMS + ", day date")

    def marks(self) -> DataFrame:
        return self._read("marks", partials.MARKS + ", day date")

    def arrive(self, events: DataFrame) -> None:
        """Take canonical events in, early or late. They are read twice, for their hours first."""
        hours = events.where("event_time is not null").select(hour_of().alias("hour_ts")).distinct()
        hours.write.parquet(f"{self.path}/dirty/{uuid.uuid4().hex}")
        events.withColumn("day", F.to_date("event_time")).write.mode("append").partitionBy("day").parquet(f"{self.path}/events")

    def dirty(self) -> list[str]:
        place, store = self._folder("dirty")
        found = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
        return sorted(n for n in found if store.exists(self._folder(f"dirty/{n}/_SUCCESS")[0]))

    def days(self, names: list[str]) -> list:
        """The days of the dirty hours of some arrivals."""
        hours = self.spark.read.schema("hour_ts timestamp_ntz").parquet(*[f"{self.path}/dirty/{n}" for n in names])
        return [r[0] for r in hours.select(F.to_date("hour_ts")).distinct().collect()]  # days, not events

    def refresh(self) -> list:
        """Compute the days anew that have had arrivals; which they were."""
        names = self.dirty()
        days = self.days(names) if names else []
        if days:
            facts = kept(metrics.facts(self.events().where(F.col("day").isin(days))))  # reads these days' partitions alone
            partials.numbered(facts, self.ids()).write.mode("append").parquet(f"{self.path}/ids")
            by_day = lambda df: df.withColumn("day", F.to_date("hour_ts")).repartition("day", F.hour("hour_ts"))
            for name, df in (("marks", partials.marks(facts, self.ids())), ("sums", partials.sums(facts))):
                by_day(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{name}")
        for n in names:
            place, store = self._folder(f"dirty/{n}")
            store.delete(place, True)
        return sorted(days)

    def between(self, start, end) -> tuple[DataFrame, DataFrame]:
        """(sums, marks) of the hours in [start, end); other days' files aren't read."""
        own = lambda df: df.where((F.col("day") >= F.to_date(at(start))) & (F.col("day") <= F.to_date(at(end))) & (F.col("hour_ts") >= at(start)) & (F.col("hour_ts") < at(end)))
        return own(self.sums()), own(self.marks())

    def tally(self) -> DataFrame:
        return partials.tally(self.sums().drop("day"), self.marks())

    def wide(self) -> DataFrame:
        """The wide hourly table."""
        return metrics.wide_of(self.tally())

    def detected(self, window: Window, cfg: DetectionConfig = DetectionConfig()) -> tuple[DataFrame, DataFrame]:
        """(baselines, anomalies) of a window, as ``pipeline.detect`` finds them in the events; no event is read."""
        from datetime import timedelta

        from . import pipeline

        own_sums, own_marks = self.between(window.start - timedelta(hours=max(28 * 24, cfg.baseline_hours)), window.end)
        own_marks = kept(own_marks)
        long = kept(metrics.metrics_long(metrics.wide_of(partials.tally(own_sums.drop("day"), own_marks))))
        return pipeline.judged(long, partials.all_rules(own_sums, own_marks, rules.one_window(own_sums, window), cfg), window, cfg)
