"""Messages to a webhook as a batch sink: ``df.write.format("millrace_webhook")``.

Tasks make messages and send nothing; the driver sends them once all tasks are through, so a task that fails or runs twice sends nothing twice, and a write that fails sends nothing at all. Each message goes with its key
(header Idempotency-Key), by which a receiver can tell a write that was begun again. Meant for alerts: a write of more than ``most`` messages is refused.

Options: url; key (the column that names a message; default: a digest of the row); payload (the column that holds the message as JSON; default: the row as a JSON object); tries; most.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import sinks
from .workers import ship

NAME = "millrace_webhook"


@dataclass
class Messages(WriterCommitMessage):
    """(key, payload) of a task's rows."""

    rows: list


class Writer(DataSourceWriter):
    def __init__(self, options, names: list[str]):
        self.options, self.names, self.most = options, names, int(options.get("most", 1000))
        if not options.get("url"):
            raise ValueError("option url is missing")

    def write(self, iterator) -> Messages:
        own, payload, out = self.options.get("key"), self.options.get("payload"), []
        for row in iterator:
            one = dict(zip(self.names, row, strict=True))
            text = one[payload] if payload else json.dumps(one, default=str)
            out.append((str(one[own]) if own else hashlib.sha256(text.encode()).hexdigest(), text))
            if len(out) > self.most:
                raise ValueError(f"over {self.most} messages; set option most if they are meant")
        return Messages(out)

    def commit(self, messages: list) -> None:
        found = dict(pair for m in messages if m is not None for pair in m.rows)  # a key once
        if len(found) > self.most:
            raise ValueError(f"{len(found)} messages, over {self.most}; set option most if they are meant")
        lost = [key for key, text in sorted(found.items()) if not sinks.deliver(json.loads(text), self.options["url"], lambda p, u, key=key: sinks.post(p, u, {"Idempotency-Key": key}), int(self.options.get("tries", 3)))]
        if lost:
            raise RuntimeError(f"{len(lost)} of {len(found)} messages weren't taken, {lost[0]} among them")

    def abort(self, messages: list) -> None:
        """Nothing has been sent."""


class Webhook(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.names)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Webhook)


def send(messages: DataFrame, url: str, ledger: str, key: str = "incident_key", tries: int = 3) -> int:
    """Send the messages whose key the ledger (a Parquet folder of keys) lacks, then note their keys; how many went. A crash in between sends them again under the same keys."""
    spark = messages.sparkSession
    register(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    known = spark.read.schema("key string").parquet(ledger) if there else spark.createDataFrame([], "key string")
    from .tables import kept

    new = kept(messages.join(known, F.col(key) == F.col("key"), "left_anti"))
    count = new.count()
    if count:
        new.write.format(NAME).mode("append").options(url=url, key=key, tries=tries, most=max(1000, count)).save()
        new.select(F.col(key).cast("string").alias("key")).write.mode("append").parquet(ledger)
    return count
