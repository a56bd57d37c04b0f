"""The webhook sink against a server of its own on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from millrace.sources import webhook


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.got.append((self.headers["Idempotency-Key"], body))
            self.send_response(self.server.answers.pop(0) if self.server.answers else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.got, s.answers = [], []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def url(server):
    return f"http://127.0.0.1:{server.server_port}/"


def test_each_message_once_and_refusals_raised(spark, server):
    webhook.register(spark)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "incident_key string, n int").repartition(3)
    server.answers = [503, 200]
    df.write.format(webhook.NAME).mode("append").options(url=url(server), key="incident_key").save()
    assert [k for k, _ in server.got] == ["a", "a", "b"] and server.got[-1][1] == {"incident_key": "b", "n": 2}
    server.answers = [404]
    with pytest.raises(Exception, match="weren't taken"):
        df.where("n = 1").write.format(webhook.NAME).mode("append").options(url=url(server), key="incident_key").save()
    with pytest.raises(Exception, match="over 1 messages"):
        df.coalesce(1).write.format(webhook.NAME).mode("append").options(url=url(server), most=1).save()
    with pytest.raises(Exception, match="url"):
        df.write.format(webhook.NAME).mode("append").save()


def test_a_write_that_fails_sends_nothing(spark, server):
    webhook.register(spark)
    df = spark.range(40).repartition(4).select(F.col("id"), F.when(F.col("id") == 17, F.raise_error(F.lit("a task dies"))).otherwise("x").alias("x"))
    with pytest.raises(Exception, match="a task dies"):
        df.write.format(webhook.NAME).mode("append").options(url=url(server), key="id").save()
    assert server.got == []


def test_a_ledger_keeps_what_was_sent(spark, server, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "incident_key string, n int")
    assert webhook.send(df, url(server), str(tmp_path / "l")) == 2 and webhook.send(df.unionByName(spark.createDataFrame([("c", 3)], df.schema)), url(server), str(tmp_path / "l")) == 1
    assert sorted(k for k, _ in server.got) == ["a", "b", "c"] and webhook.send(df, url(server), str(tmp_path / "l")) == 0
