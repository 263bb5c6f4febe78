from __future__ import annotations

import csv
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from posttide import schemas
from posttide.operators import state
from posttide.params import SearchParams
from posttide.plans import jobs
from posttide.plans.scorers import analyze, lexicon_scorer, resolve_scorer
from posttide.operators.lexicon import seed_lexicon
from posttide.sinks import exports
from posttide.sinks.store import PostStore

AT = datetime(2026, 5, 6, 10, 0)


def fixed_scorer(label="positive", score=0.7, confidence=0.9):
    def score_all(texts, keys):
        return texts.select(
            *keys,
            F.lit(label).alias("label"),
            F.lit(score).alias("score"),
            F.lit(confidence).alias("confidence"),
            F.lit("{}").alias("metadata"),
        )

    return score_all


def posts(spark, rows):
    full = [
        (i, AT, "openai", "OpenAI", content, "https://x.com/openai/status/1", likes, 5, "en",
         '{"tweet_id":"%s"}' % i)
        for i, content, likes in rows
    ]
    return spark.createDataFrame(full, schemas.RAW_POST).coalesce(1)


def stored(spark, rows, **kw):
    numbered = posts(spark, rows).withColumn("ordinal", F.monotonically_increasing_id())
    return analyze(numbered, fixed_scorer(**kw))


def likes(store):
    return {r["tweet_id"]: r["like_count"] for r in store.tweets().collect()}


def test_upsert_last_wins_and_is_idempotent(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    assert store.tweets().count() == 0
    store.compact()
    first = stored(spark, [("a", "one", 1), ("b", "two", 2), ("a", "three", 3)])
    assert store.upsert_tweets(first) == 3
    assert likes(store) == {"a": 3, "b": 2}
    second = stored(spark, [("b", "new", 9), ("c", "see", 4)], label="negative")
    assert store.upsert_tweets(second, "w", 2) == 2
    assert store.upsert_tweets(second, "w", 2) == 2
    assert store.upsert_tweets(second.limit(0), "w", 3) == 0
    for step in range(3):
        rows = {r["tweet_id"]: (r["like_count"], r["sentiment_label"]) for r in store.tweets().collect()}
        assert rows == {"a": (3, "positive"), "b": (9, "negative"), "c": (4, "negative")}, step
        store.vacuum() if step else store.compact()
    assert store.upsert_tweets(stored(spark, [("a", "last", 7)])) == 1
    assert likes(store) == {"a": 7, "b": 9, "c": 4}
    store.compact()
    store.vacuum()
    assert likes(store) == {"a": 7, "b": 9, "c": 4}
    assert store.tweets().schema.names == schemas.TWEETS.names


def test_replayed_batches_keep_their_place(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    store.upsert_tweets(stored(spark, [("a", "x", 1), ("b", "x", 1)]), "one", 0)
    store.upsert_tweets(stored(spark, [("a", "x", 2)]), "two", 0)
    store.upsert_tweets(stored(spark, [("a", "x", 1), ("b", "x", 1)]), "one", 0)
    assert likes(store) == {"a": 2, "b": 1}
    store.compact()
    store.upsert_tweets(stored(spark, [("b", "x", 5)]), "two", 1)
    assert store.upsert_tweets(stored(spark, [("a", "x", 1), ("b", "x", 1)]), "one", 0) == 2
    assert likes(store) == {"a": 2, "b": 5}


def test_a_fold_counts_when_it_is_finished(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    store.upsert_tweets(stored(spark, [("a", "x", 1), ("b", "x", 1)]), "one", 0)
    store.compact()
    store.upsert_tweets(stored(spark, [("a", "x", 2)]), "one", 1)
    # What a compaction leaves that died before its entry in ``folds``.
    store.tweets().limit(0).write.parquet(store._posts_path(2, 1))
    assert likes(store) == {"a": 2, "b": 1}
    store.compact()
    assert likes(store) == {"a": 2, "b": 1}


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    store = PostStore(spark, str(tmp_path), buckets=8)
    many = [(str(i), "x", 1) for i in range(100)]
    store.upsert_tweets(stored(spark, many))
    store.compact()
    before = store._newest_folds()[0]
    assert len(before) == 8 and set(before.values()) == {1}
    store.upsert_tweets(stored(spark, [("7", "x", 2)]))
    store.compact()
    after = store._newest_folds()[0]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and sum(likes(store).values()) == 101
    assert PostStore(spark, str(tmp_path), buckets=3)._newest_folds()[1] == 8


def test_links_keep_first_time(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "tweet_id string")
    store.link_tweets(1, ids)
    before = {tuple(r) for r in store.links().collect()}
    store.link_tweets(1, ids)
    store.link_tweets(2, ids.limit(1))
    after = {tuple(r) for r in store.links().collect()}
    assert len(before) == 2 and before < after and len(after) == 3


def test_run_log(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    one = store.open_run("q1", "vader", "auto", "x_api")
    two = store.open_run("q2", "ml", "auto", "x_api")
    assert (one, two) == (1, 2)
    store.complete_run(one, 5, 5, "news_rss", True, "raw.csv", None)
    store.fail_run(two, "boom")
    store.fail_run(77, "never opened")
    runs = {r["id"]: r for r in state.recent_runs(store.runs()).collect()}
    assert set(runs) == {1, 2}
    assert (runs[1]["status"], runs[1]["served_backend"], runs[1]["fallback_used"]) == (
        "completed", "news_rss", True)
    assert (runs[2]["status"], runs[2]["error_message"], runs[2]["total_stored"]) == ("failed", "boom", 0)
    assert runs[2]["served_backend"] == "unknown"


def test_ingest_job(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    readers = {
        "twscrape": lambda: posts(spark, []),
        "news_rss": lambda: posts(
            spark, [("tweet-1", "OpenAI release looks strong", 42), ("tweet-2", "unrelated", 1)]
        ),
    }
    params = SearchParams("openai", ("AI",), max_results=25)
    result = jobs.ingest(
        store, params, readers, fixed_scorer(), "vader", "auto", ("twscrape",),
        str(tmp_path / "raw"), str(tmp_path / "processed"),
    )
    assert (result.requested_backend, result.resolved_backend, result.served_backend) == (
        "auto", "twscrape", "news_rss")
    assert result.fallback_used and (result.collected_count, result.stored_count) == (1, 1)
    report = jobs.run_report(store, result.run_id)
    run = report["history"].first()
    assert run["raw_export_path"] and run["processed_export_path"]
    source = report["sources"].first()
    assert (source["display_name"], source["tweet_count"], source["average_engagement"]) == ("OpenAI", 1, 47.0)
    assert report["summary"].first()["dominant_sentiment"] == "positive"
    assert report["series"].first()["rolling_average"] == pytest.approx(0.7)
    preview = report["export_preview"]
    assert tuple(preview.columns) == exports.PROCESSED_COLUMNS
    assert preview.first()["tokens"] == '["openai","release","looks","strong"]'
    assert Path(result.processed_export_path).name.startswith("keyword_openai_hashtags_ai_start_end_limit_25_")
    assert jobs.run_report(store, 99) == {}

    def broken():
        raise OSError("down")

    with pytest.raises(OSError):
        jobs.ingest(store, params, {"snscrape": broken, "news_rss": broken}, fixed_scorer(), "vader")
    assert state.recent_runs(store.runs(), 1).first()["status"] == "failed"


def test_empty_batch_writes_no_export(spark, tmp_path):
    none = posts(spark, [])
    assert exports.export_raw(none, str(tmp_path / "x.csv")) is None
    assert exports.read_export(spark, str(tmp_path / "x.csv")).count() == 0


def test_raw_export_takes_the_union_of_keys(spark, tmp_path):
    rows = spark.createDataFrame([('{"a":1,"b":"x, \\"y\\"\\nz"}',), ('{"b":"q","c":{"d":2}}',)], "raw_payload string")
    path = exports.export_raw(rows.coalesce(1), str(tmp_path / "raw.csv"))
    part = next(Path(path).glob("part-*"))
    with part.open(newline="") as handle:
        got = list(csv.DictReader(handle))
    assert got == [{"a": "1", "b": 'x, "y"\nz', "c": ""}, {"a": "", "b": "q", "c": '{"d":2}'}]


def test_analyze_with_lexicon(spark):
    rows = [("1", "I absolutely love this product. It is amazing and delightful.", 0), ("2", "#only @tags", 0)]
    numbered = posts(spark, rows).withColumn("ordinal", F.monotonically_increasing_id())
    got = {r["tweet_id"]: r for r in analyze(numbered, lexicon_scorer(seed_lexicon(spark))).collect()}
    assert got["1"]["sentiment_label"] == "positive" and got["1"]["sentiment_score"] > 0
    assert 0.0 <= got["1"]["sentiment_confidence"] <= 1.0
    empty = got["2"]
    assert (empty["sentiment_label"], empty["sentiment_score"], empty["sentiment_confidence"]) == ("neutral", 0.0, 1.0)
    assert empty["sentiment_metadata"] == '{"reason":"empty_cleaned_text"}'
    assert empty["tokens"] == []
    with pytest.raises(ValueError):
        resolve_scorer(spark, "other")


def test_conform_and_audits(spark):
    old = spark.createDataFrame([(1, "q")], "id bigint, source_query string")
    new = state.conform(old, "ingestion_runs").first()
    assert (new["served_backend"], new["fallback_used"], new["raw_export_path"]) == ("unknown", False, None)
    links = spark.createDataFrame([(1, "a"), (1, "z"), (2, "a")], "run_id bigint, tweet_id string")
    tweets = spark.createDataFrame([("a",), ("a",), ("b",)], "tweet_id string")
    assert [r["tweet_id"] for r in state.orphans(links, "tweet_id", tweets, "tweet_id").collect()] == ["z"]
    assert [tuple(r) for r in state.key_violations(tweets, ["tweet_id"]).collect()] == [("a", 2)]
    kept, left = state.delete_cascade(tweets, links, "tweet_id", "tweet_id", tweets.filter("tweet_id = 'a'"))
    assert [r[0] for r in kept.collect()] == ["b"]
    assert [r["tweet_id"] for r in left.collect()] == ["z"]
