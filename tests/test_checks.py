"""The named queries against their SQL on the smallest tables, where those exist."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import TABLES, _rows

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"ml_cv_metrics", "ml_predict"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_series_invariants(spark):
    """Gap-filled counts add up to the summary, shares to 100, partitions do not matter."""
    queries = entry.queries()
    filled = queries["ts_hourly_all_runs"](spark, SF_DIR).groupBy("run_id").sum("total_tweets")
    totals = {r["run_id"]: r["sum(total_tweets)"] for r in filled.collect()}
    summary = {r["run_id"]: r for r in queries["summary_stats"](spark, SF_DIR).collect()}
    assert totals == {k: r["total_tweets"] for k, r in summary.items()}
    for row in summary.values():
        shares = row["positive_percentage"] + row["negative_percentage"] + row["neutral_percentage"]
        assert shares == pytest.approx(100.0)
    one = queries["summary_stats_one_run"](spark, SF_DIR).first().asDict()
    assert one == {k: x for k, x in summary[2].asDict().items() if k != "run_id"}
    before = sorted(map(str, queries["training_corpus"](spark, SF_DIR).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(str, queries["training_corpus"](spark, SF_DIR).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", ["upsert_latest", "lexicon_score", "cascade_delete"])
def test_shuffle_joins_give_the_same(spark, con, name, monkeypatch):
    """Beyond the broadcast bound the same rows come out of shuffle joins."""
    from posttide import session

    monkeypatch.setattr(session.lookup_side, "__defaults__", (None, -1))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_equals_sql(spark, con, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
