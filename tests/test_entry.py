"""The registered queries: every one has SQL, and they agree at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue

from .conftest import DATA

SF = DATA / "sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["q_hourly_event_counts", "q_hourly_metrics_joined", "q_metrics_long", "q_rolling_baseline_all_hours", "q_same_hour_baseline_window", "q_zscore_view", "q_iqr_all", "q_rules_all", "q_incident_upsert", "q_backtest_eval", "q_suppression", "q_retention"])
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
