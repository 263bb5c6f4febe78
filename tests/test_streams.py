from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from posttide import schemas
from posttide.operators import series
from posttide.operators.lexicon import seed_lexicon
from posttide.plans.scorers import lexicon_scorer
from posttide.sinks.store import PostStore
from posttide.streaming import streams


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"id": i, "date": f"2026-05-06T{h:02d}:10:00Z", "rawContent": text,
                    "user": {"username": "u", "displayname": "U"}})
        for i, h, text in rows
    ]
    (folder / name).write_text("\n".join(lines))


def test_ingest_stream_upserts_each_batch(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    scorer = lexicon_scorer(seed_lexicon(spark))
    land(tmp_path / "in", "1.json", [("a", 1, "good"), ("b", 2, "bad")])
    for name, rows in (("2.json", [("a", 3, "awful"), ("c", 4, "plain")]), (None, None)):
        query = streams.ingest_stream(
            streams.scraped_stream(spark, str(tmp_path / "in")), store, scorer, 1, str(tmp_path / "cp")
        )
        query.awaitTermination()
        if name:
            assert store.tweets().count() == 2
            land(tmp_path / "in", name, rows)
    got = {r["tweet_id"]: r["sentiment_label"] for r in store.tweets().collect()}
    assert got == {"a": "negative", "b": "negative", "c": "neutral"}
    assert store.links().count() == 3


def test_streams_and_runs_share_a_store(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    scorer = lexicon_scorer(seed_lexicon(spark))

    def run(name, run_id):
        found = streams.scraped_stream(spark, str(tmp_path / name))
        streams.ingest_stream(found, store, scorer, run_id, str(tmp_path / f"cp-{name}")).awaitTermination()

    land(tmp_path / "one", "1.json", [("a1", 1, "good"), ("a2", 2, "bad")])
    run("one", 1)
    land(tmp_path / "two", "1.json", [("b1", 1, "good")])
    run("two", 2)
    assert {r["tweet_id"] for r in store.tweets().collect()} == {"a1", "a2", "b1"}
    store.compact()
    land(tmp_path / "three", "1.json", [("c1", 1, "good"), ("a1", 2, "awful")])
    run("three", 3)
    land(tmp_path / "one", "2.json", [("a3", 3, "plain")])
    run("one", 1)
    got = {r["tweet_id"]: r["sentiment_label"] for r in store.tweets().collect()}
    assert set(got) == {"a1", "a2", "a3", "b1", "c1"} and got["a1"] == "negative"
    assert store.links().join(store.tweets(), "tweet_id", "left_anti").count() == 0


def test_a_crash_between_two_streams_loses_nothing(spark, tmp_path):
    """A stream dies while it writes, another one runs, the store is compacted, the first comes back."""
    scorer = lexicon_scorer(seed_lexicon(spark))

    class Dying(PostStore):
        def upsert_tweets(self, analyzed, writer=None, batch=0):
            raise OSError("executor host is gone")

    def run(name, run_id, store):
        found = streams.scraped_stream(spark, str(tmp_path / name))
        streams.ingest_stream(found, store, scorer, run_id, str(tmp_path / f"cp-{name}")).awaitTermination()

    store = PostStore(spark, str(tmp_path / "store"))
    land(tmp_path / "one", "1.json", [("a1", 1, "good")])
    with pytest.raises(StreamingQueryException):
        run("one", 1, Dying(spark, str(tmp_path / "store")))
    land(tmp_path / "two", "1.json", [("b1", 1, "good")])
    run("two", 2, store)
    store.compact()
    run("one", 1, store)
    assert {r["tweet_id"] for r in store.tweets().collect()} == {"a1", "b1"}
    assert store.links().join(store.tweets(), "tweet_id", "left_anti").count() == 0
    store.compact()
    assert {r["tweet_id"] for r in store.tweets().collect()} == {"a1", "b1"}


def test_series_stream_equals_batch(spark, tmp_path):
    start = datetime(2026, 5, 6)
    rows = [(1, start + timedelta(minutes=7 * i), ("positive", "neutral")[i % 2], i / 100) for i in range(60)]
    schema = "run_id bigint, created_at timestamp, sentiment_label string, sentiment_score double"
    posts = spark.createDataFrame(rows, schema)
    posts.write.parquet(str(tmp_path / "posts"))
    source = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "posts"))
    query = (
        streams.series_stream(source, "hourly").writeStream.outputMode("complete").format("memory")
        .queryName("series_out").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = series.series_of(posts, "hourly")
    key = "run_id", "period", "total_tweets", F.round("average_sentiment", 9), "positive_count"
    streamed = spark.table("series_out").select(*key).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch.select(*key).collect()))


def test_stream_dedupe(spark, tmp_path):
    at = datetime(2026, 5, 6)
    rows = [(i, at, "u", "U", "c", "", 0, 0, "en", "{}") for i in ("a", "b", "a", "a")]
    spark.createDataFrame(rows, schemas.RAW_POST).write.parquet(str(tmp_path / "posts"))
    source = spark.readStream.schema(schemas.RAW_POST).parquet(str(tmp_path / "posts"))
    query = (
        streams.first_per_id(source).writeStream.format("memory").queryName("dedupe_out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["tweet_id"] for r in spark.table("dedupe_out").collect()) == ["a", "b"]
