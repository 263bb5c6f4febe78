"""What one task, one batch or one compaction is given stays bounded."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from posttide import schemas
from posttide.checks import search as check_search
from posttide.operators import search
from posttide.operators.lexicon import seed_lexicon
from posttide.params import SearchParams
from posttide.plans.scorers import lexicon_scorer
from posttide.session import shared_dir
from posttide.sinks.store import PostStore
from posttide.streaming import streams


def test_python_gets_texts_in_small_batches(spark):
    @F.pandas_udf("long")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    texts = spark.range(32, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))
    assert texts.select(F.max(rows("text"))).first()[0] <= 5


def test_a_cap_of_the_largest_search_is_cut_by_ranges(spark):
    rows = spark.range(2000, numPartitions=4).withColumn("k", F.col("id") % 7)
    for cap in (1500, 100_000):
        capped = search.cap_rows(rows, ["k", "id"], cap)
        assert "TakeOrdered" not in capped._jdf.queryExecution().executedPlan().toString()
        want = sorted((i % 7, i) for i in range(2000))[:cap]
        assert sorted((r["k"], r["id"]) for r in capped.collect()) == want


def test_a_search_that_finds_more_than_its_large_cap_is_cut(spark):
    days = F.expr("timestamp'2026-05-01 00:00:00'")
    posts = spark.range(2500, numPartitions=4).select(
        F.lit("p").alias("page_key"), F.col("id").alias("item_idx"), (F.col("id") % 2000).cast("string").alias("tweet_id"),
        days.alias("created_at"), F.lit("on topic").alias("content"),
    )
    params = SearchParams("topic", (), max_results=1500)
    chosen = search.chosen_posts(posts, params, "twscrape", datetime(2026, 5, 2, tzinfo=timezone.utc))
    assert chosen.columns == posts.columns
    assert sorted(r["item_idx"] for r in chosen.collect()) == list(range(1500))


def test_landed_feed_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    html = F.concat(F.lit("<title>t"), F.col("id"), F.lit("</title>"), F.repeat(F.lit("word "), F.lit(200)))
    pages = spark.range(200).select(
        F.when(F.col("id") > 0, F.col("id")).alias("page_id"),
        F.concat(F.lit("https://h.org/"), F.col("id")).alias("url"), html.alias("html"),
    )
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(check_search, "working_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(check_search, "_FILE_CHARS", 10_000, raising=False)
    found = check_search.QUERIES["landed_feed"](spark, str(tmp_path))
    assert found.select("url").distinct().count() == 200
    sizes = [f.stat().st_size for f in tmp_path.glob("feeds/*/part-*")]
    assert len(sizes) > 15 and max(sizes) < 40_000


def _posts(spark, rows):
    made = spark.createDataFrame(rows, "tweet_id string, content string, ordinal long")
    given = set(made.columns)
    return made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.TWEETS.fields if f.name not in given])


def test_compaction_merges_where_rows_are_placed_once(spark, tmp_path):
    store = PostStore(spark, str(tmp_path), buckets=4)
    moved = []
    frames = ("repartitionByRange", "repartition")
    kinds = type(spark.range(1))
    plain = {name: getattr(kinds, name) for name in frames}
    try:
        for name in frames:
            setattr(kinds, name, lambda df, *a, _n=name: (moved.append(_n), plain[_n](df, *a))[1])
        store.upsert_tweets(_posts(spark, [("a", "1", 0), ("a", "2", 1), ("b", "1", 2), (None, "1", 3)]), "one")
        store.compact()
        store.upsert_tweets(_posts(spark, [("a", "3", 0), ("c", "1", 1), (None, "2", 2)]), "two")
        store.compact()
    finally:
        for name in frames:
            setattr(kinds, name, plain[name])
    assert moved == ["repartition", "repartition"]
    got = sorted((str(r["tweet_id"]), r["content"]) for r in store.tweets().collect())
    assert got == [("None", "1"), ("None", "2"), ("a", "3"), ("b", "1"), ("c", "1")]
    files = list(tmp_path.glob("posts/*/*/*.parquet"))
    assert files and all(".zstd." in f.name for f in files)


def test_a_batch_that_fails_leaves_nothing_behind(spark, tmp_path):
    class Dying(PostStore):
        def link_tweets(self, run_id, tweet_ids):
            raise OSError("the driver's host is gone")

    def held():
        return set(spark.sparkContext._jsc.sc().getPersistentRDDs().keys().mkString(" ").split())

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "a", "date": "2026-05-06T01:10:00Z", "rawContent": "good"}')
    before, tables = held(), {t.name for t in spark.catalog.listTables()}
    folders = set(Path(shared_dir(spark)).glob("bucketed-*"))
    store = Dying(spark, str(tmp_path / "store"))
    query = streams.ingest_stream(
        streams.scraped_stream(spark, str(tmp_path / "in")), store, lexicon_scorer(seed_lexicon(spark)), 1, str(tmp_path / "cp")
    )
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    assert store.tweets().count() == 1
    assert held() <= before and {t.name for t in spark.catalog.listTables()} <= tables
    assert set(Path(shared_dir(spark)).glob("bucketed-*")) <= folders


def test_compaction_keeps_tokens_of_any_kind(spark, tmp_path):
    kinds = [None, [], [""], ["", ""], ["a b"], [None, "x"], ["a", "b", ""], [" "]]
    rows = [(str(i), tokens, i) for i, tokens in enumerate(kinds)]
    made = spark.createDataFrame(rows, "tweet_id string, tokens array<string>, ordinal long")
    rest = [f for f in schemas.TWEETS.fields if f.name not in made.columns]
    posts = made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    store = PostStore(spark, str(tmp_path), buckets=2)
    store.upsert_tweets(posts, "one")
    store.compact()
    store.vacuum()
    assert {r["tweet_id"]: r["tokens"] for r in store.tweets().collect()} == {i: t for i, t, _ in rows}
