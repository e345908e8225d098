"""Shapes of plans that must hold at scale, and a sample of queries against their SQL."""

import duckdb
import pytest

from helpers import plain, rows_of
from tapline.operators import behaviors, correlate, features
from tapline.plans.catalog import QUERIES
from tapline.plans.oracle import ORACLE
from tapline.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "orders", "lineitem", "events", "documents", "labels", "embeddings"]
SAMPLE = ["traffic_view", "port_scan", "host_sweep", "incidents", "incident_alerts", "flow_sessions", "flow_tcp_state",
          "window_volume", "window_iat_stats", "window_spectrum", "risk_levels", "kitsune_online", "ewma_zscore",
          "dashboard_grouping_sets", "chain_append", "pr_auc", "modbus_decode", "intel_as_of", "stream_signals"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    r = duck.execute(ORACLE[name])
    cols = [d[0] for d in r.description]
    order = [cols.index(c) for c in sorted(cols)]
    expect = sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=str)
    assert sorted(got.columns) == sorted(cols) and rows_of(got) == expect


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_behaviours_shuffle_once(spark):
    stored = tables.traffic(spark.read.parquet(f"{SF}/events.parquet"))
    p = _plan(behaviors.behavioural_signals(stored))
    assert p.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_only_needed_columns_are_read(spark):
    p = _plan(behaviors.port_scans(tables.batch_traffic(spark, SF)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in p


def test_no_join_without_keys(spark):
    t = tables.batch_traffic(spark, SF)
    for df in (correlate.incidents(behaviors.behavioural_signals(t)), features.window_features(tables.flagged(t))):
        p = _plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_inputs_are_not_recomputed(spark):
    def scans(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans("retention_topn") <= 3 and scans("all_signals") <= 3
    assert scans("flow_stats") <= scans("flow_sessions") + 2
