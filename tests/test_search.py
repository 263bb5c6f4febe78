from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from posttide import schemas
from posttide.operators import search
from posttide.params import SearchParams, resolve_source
from posttide.sources import posts as landed

PARAMS = SearchParams("openai", ("AI", "llm"), date(2026, 5, 1), date(2026, 5, 6), 25)
FEED = """<rss><channel><title>Feed</title>
<item><title>Harbour town opens a library of tools - The Quay</title>
<link>https://news.test/tools</link><guid>quay-17</guid>
<pubDate>Mon, 04 May 2026 21:07:30 GMT</pubDate>
<source url="https://quay.test">The Quay</source>
<description><![CDATA[<b>Harbour town opens a library of tools - The Quay</b>]]></description></item>
<item><title>A bridge of last year</title><link>https://news.test/bridge</link>
<guid>quay-03</guid><pubDate>Fri, 13 Jun 2025 05:00:00 GMT</pubDate>
<source url="https://quay.test">The Quay</source><description>Opened in rain</description></item>
<item><title>Undated by mistake</title><guid>quay-04</guid><pubDate>some day</pubDate></item>
</channel></rss>"""


def test_search_texts():
    assert PARAMS.search_text() == "openai #AI #llm since:2026-05-01 until:2026-05-07"
    assert PARAMS.api_text() == "openai #AI #llm"
    assert PARAMS.topic_variants() == [
        "openai AI llm", "openai AI", "openai llm", "AI llm", "openai OR AI OR llm",
        "openai", "AI", "llm",
    ]
    assert SearchParams("a", ("A",)).topic_variants() == ["a A", "A", "a OR A"]
    assert PARAMS.source_query == (
        "keyword=openai;hashtags=#AI,#llm;start=2026-05-01;end=2026-05-06;limit=25"
    )


@pytest.mark.parametrize(
    "params",
    [
        SearchParams(),
        SearchParams(hashtags=(" ",)),
        SearchParams("a", max_results=0),
        SearchParams("a", (), date(2026, 1, 2), date(2026, 1, 1)),
    ],
)
def test_bad_searches(params):
    with pytest.raises(ValueError):
        params.validate()


def test_recent_bounds():
    now = datetime(2026, 5, 6, 12, tzinfo=timezone.utc)
    start, end = PARAMS.recent_bounds(now)
    assert start == datetime(2026, 5, 1, tzinfo=timezone.utc)
    assert end == now
    for bad in (date(2026, 4, 20), date(2026, 5, 9)):
        with pytest.raises(ValueError):
            SearchParams("a", (), bad).recent_bounds(now)


def test_sources_resolve():
    assert resolve_source("AUTO", ("twscrape", "x_api")) == ("auto", "x_api")
    assert resolve_source("auto") == ("auto", "snscrape")
    assert resolve_source("news_rss") == ("news_rss", "news_rss")
    with pytest.raises(ValueError):
        resolve_source("ftp")


def test_feed_file_to_posts(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    items = landed.read_feed_items(spark, str(tmp_path / "feed.xml"))
    now = datetime(2026, 5, 7, tzinfo=timezone.utc)
    posts = landed.posts_from_feed(items, now, "openai")
    inside = search.in_date_window(F.col("created_at"), PARAMS.start_date, PARAMS.end_date)
    rows = posts.filter(inside).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["display_name"], row["username"], row["item_idx"]) == ("The Quay", "the_quay", 0)
    assert row["url"] == "https://news.test/tools"
    assert row["content"] == "Harbour town opens a library of tools - The Quay"
    assert [r["guid"] for r in landed.quarantined_items(items).collect()] == ["quay-04"]
    assert [r["item_idx"] for r in items.orderBy("item_idx").collect()] == [0, 1, 2]
    payload = spark.createDataFrame([row["raw_payload"]], "string").select(
        F.get_json_object("value", "$.source_type"), F.json_object_keys("value")
    ).first()
    assert payload[0] == "google_news_rss"
    assert len(payload[1]) == 15


def test_api_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(
        '{"data": [{"id": "1", "text": "hi", "created_at": "2026-05-06T10:00:00.000Z",'
        ' "author_id": "9", "public_metrics": {"like_count": 3}},'
        ' {"id": "2", "text": "yo", "created_at": "2026-05-06T11:00:00Z", "author_id": "8"}],'
        ' "includes": {"users": [{"id": "9", "username": "old", "name": "O"},'
        ' {"id": "9", "username": "ann", "name": "Ann"}]}, "meta": {}}'
    )
    (tmp_path / "p2.json").write_text('{"data": [{"id": "3", "text": "x"}], "errors": [{"message": "m"}]}')
    (tmp_path / "p3.json").write_text('{"data": [], "meta": {}}')
    pages = landed.read_api_pages(spark, str(tmp_path))
    posts = {r["tweet_id"]: r for r in landed.posts_from_pages(pages).collect()}
    assert set(posts) == {"1", "2"}
    assert posts["1"]["url"] == "https://x.com/ann/status/1"
    assert (posts["1"]["like_count"], posts["1"]["retweet_count"]) == (3, 0)
    assert (posts["2"]["username"], posts["2"]["url"], posts["2"]["lang"]) == ("unknown", "", "unknown")
    rejected = landed.rejected_pages(pages).collect()
    assert [r["message"] for r in rejected] == ["X API request failed: m"]


def _posts(spark, ids):
    rows = [(i, datetime(2026, 5, 6), "u", "U", "c", "", 0, 0, "en", "{}") for i in ids]
    return spark.createDataFrame(rows, schemas.RAW_POST)


def test_fetch_falls_back(spark):
    readers = {"twscrape": lambda: _posts(spark, []), "news_rss": lambda: _posts(spark, ["news-1"])}
    batch = search.fetch_batch(readers, "auto", "twscrape")
    assert batch.posts.first()["tweet_id"] == "news-1"
    assert (batch.served_backend, batch.fallback_used) == ("news_rss", True)

    def broken():
        raise OSError("primary")

    readers = {"twscrape": broken, "news_rss": lambda: _posts(spark, [])}
    with pytest.raises(OSError, match="primary"):
        search.fetch_batch(readers, "auto", "twscrape")
    readers["twscrape"] = lambda: _posts(spark, [])
    batch = search.fetch_batch(readers, "auto", "twscrape")
    assert (batch.posts.count(), batch.served_backend, batch.fallback_used) == (0, "news_rss", True)


def test_first_seen_agrees_with_materialized_fanout(spark):
    params = SearchParams("red", ("blue",), max_results=4)
    texts = ["red blue", "BLUE", "green", "red", "blue red", "red"]
    rows = [(f"id{i % 4}", datetime(2026, 5, 6), text, i) for i, text in enumerate(texts)]
    posts = spark.createDataFrame(rows, "tweet_id string, created_at timestamp, content string, item_idx int")
    seen, expected = set(), []
    fanned = search.topic_fanout(posts, params).orderBy("query_idx", "item_idx").collect()
    for row in fanned:
        if row["tweet_id"] not in seen:
            seen.add(row["tweet_id"])
            expected.append((row["tweet_id"], row["item_idx"], row["query"]))
    got = search.first_seen(posts, params).orderBy("query_idx", "item_idx").collect()
    assert [(r["tweet_id"], r["item_idx"], r["query"]) for r in got] == expected[:4]


def test_large_cap_equals_plain_limit(spark, monkeypatch):
    monkeypatch.setattr(search, "_SMALL_CAP", 10)
    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("k"), "id").repartition(5)
    for cap in (11, 500, 999, 1000, 5000):
        got = {tuple(r) for r in search.cap_rows(rows, ["k", "id"], cap).collect()}
        assert got == {tuple(r) for r in rows.orderBy("k", "id").limit(cap).collect()}


def test_unreadable_dates_go_to_quarantine(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"data": [{"id": "1", "text": "a", "created_at": "soon"}, {"id": "2", "text": "b"}]}'
    )
    pages = landed.read_api_pages(spark, str(tmp_path / "p.json"))
    assert [r["tweet_id"] for r in landed.posts_from_pages(pages).collect()] == ["2"]
    assert [r["tweet"]["id"] for r in landed.quarantined_tweets(pages).collect()] == ["1"]
    (tmp_path / "s.json").write_text('{"id": "1", "date": "31/31/31"}\n{"id": "2", "date": "2026-05-06T10:00:00Z"}')
    scraped = landed.read_scraped_posts(spark, str(tmp_path / "s.json"))
    assert [r["tweet_id"] for r in landed.posts_from_scraped(scraped).collect()] == ["2"]
    assert [r["id"] for r in landed.quarantined_scraped(scraped).collect()] == ["1"]


def test_a_source_that_fails_late_brings_the_fallback(spark):
    def late():
        fails = F.raise_error(F.lit("bad part"))
        return _posts(spark, [str(i) for i in range(50)]).repartition(5).withColumn(
            "content", F.when(F.col("tweet_id") == "49", fails.cast("string")).otherwise(F.col("content"))
        )

    readers = {"twscrape": late, "news_rss": lambda: _posts(spark, ["n"])}
    batch = search.fetch_batch(readers, "auto", "twscrape")
    assert (batch.served_backend, batch.posts.count()) == ("news_rss", 1)


def test_chosen_posts_are_filtered_before_the_cap(spark):
    may = [datetime(2026, 5, d, 12) for d in range(1, 9)]
    rows = [("old", datetime(2020, 1, 1), "red"), ("a", may[2], "unrelated"), ("b", may[2], "Red #Blue x"),
            ("b", may[1], "red #blue"), ("c", may[3], "red blue"), ("d", may[4], "the RED #blue"), ("e", may[7], "red #blue")]
    full = [(i, at, "u", "U", text, "", n, 0, "en", "{}") for n, (i, at, text) in enumerate(rows)]
    posts = spark.createDataFrame(full, schemas.RAW_POST)
    params = SearchParams("red", ("blue",), date(2026, 5, 1), date(2026, 5, 6), 2)
    now = datetime(2026, 5, 7, tzinfo=timezone.utc)

    def chosen(frame, source):
        got = search.chosen_posts(frame, params, source, now)
        assert got.columns == frame.columns
        return sorted((r["tweet_id"], r["like_count"]) for r in got.collect())

    assert chosen(posts, "twscrape") == [("b", 3), ("d", 5)]
    assert chosen(posts.withColumn("item_idx", F.col("like_count")), "x_api") == [("b", 2), ("d", 5)]
    assert chosen(posts, "news_rss") == [("b", 3), ("c", 4)]
