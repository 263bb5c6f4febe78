"""Whole runs: an ingest job and two streams into one store, read back."""

from __future__ import annotations

import contextlib
from datetime import date

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide import schemas
from posttide import testviews as v
from posttide.checks import analytics, lexicon
from posttide.checks.shape import finish
from posttide.params import SearchParams
from posttide.plans import jobs
from posttide.plans.scorers import lexicon_scorer
from posttide.session import working_folder
from posttide.sinks.store import PostStore
from posttide.streaming import streams

_PARAMS = SearchParams("that", (), date(2026, 5, 3), date(2026, 5, 6), 100_000)


def _landed(spark, sf_dir) -> DataFrame:
    """A post for each document, and a later copy of some, inside the window too, with other numbers."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.withColumn("copy", F.lit(0)).unionByName(
        docs.filter("doc_id % 10 IN (0, 3, 5)").withColumn("copy", F.lit(1))
    )
    day = F.expr("timestamp'2026-05-01 12:00:00' + make_dt_interval(cast(doc_id % 10 AS int))")
    values = {
        "tweet_id": F.col("doc_id").cast("string"),
        "created_at": day,
        "username": F.lit("u"),
        "display_name": F.lit("U"),
        "content": F.col("text"),
        "url": F.lit(""),
        "like_count": F.col("doc_id") % 7 + 1000 * F.col("copy"),
        "retweet_count": F.lit(0),
        "lang": F.lit("en"),
        "raw_payload": F.lit("{}"),
    }
    return both.select(
        F.concat(F.lit("page-"), "copy").alias("page_key"),
        F.col("doc_id").alias("item_idx"),
        *[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.RAW_POST.fields],
    )


def _ingest(spark, sf_dir):
    store = PostStore(spark, working_folder(spark, "store"))
    readers = {"twscrape": lambda: _landed(spark, sf_dir)}
    scorer = lexicon_scorer(lexicon.words_of_benchmark(spark, sf_dir), lexicon.RULES)
    jobs.ingest(store, _PARAMS, readers, scorer, "vader", "twscrape")
    links = store.links().groupBy("tweet_id").agg(F.count(F.lit(1)).alias("runs"))
    return finish(
        store.tweets().join(links, "tweet_id").select(
            "tweet_id", F.to_date("created_at").alias("day"), "like_count", "runs",
            "sentiment_label", "sentiment_score", "sentiment_confidence",
        )
    )


# Streams into one store


def _scraped(spark, sf_dir) -> DataFrame:
    """Documents as scraped posts, the even ones for one stream and the odd ones for another."""
    return v.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 2).cast("int").alias("part"),
        F.to_json(
            F.struct(
                F.col("doc_id").cast("string").alias("id"),
                F.lit("2026-05-06T10:00:00Z").alias("date"),
                F.col("text").alias("rawContent"),
            )
        ).alias("value"),
    )


def _neutral(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(
        *keys, F.lit("neutral").alias("label"), F.lit(0.0).alias("score"), F.lit(1.0).alias("confidence"),
        F.lit("{}").alias("metadata"),
    )


def _stream(spark, landed: str, part: int, store: PostStore) -> None:
    posts = streams.scraped_stream(spark, f"{landed}/{part}")
    query = streams.ingest_stream(posts, store, _neutral, part + 1, f"{landed}/cp-{part}")
    query.awaitTermination()


def _linked(store: PostStore) -> DataFrame:
    sizes = store.tweets().select("tweet_id", F.length("content").cast("bigint").alias("n_chars"))
    return store.links().join(sizes, "tweet_id", "left").select("run_id", "tweet_id", "n_chars")


def _two_streams(spark, sf_dir):
    """Even documents come by one stream, odd ones by another, with a compaction in between."""
    store, landed = PostStore(spark, working_folder(spark, "store")), working_folder(spark, "landed")
    scraped = _scraped(spark, sf_dir)
    for part in (0, 1):
        scraped.filter(F.col("part") == part).select("value").write.text(f"{landed}/{part}")
        _stream(spark, landed, part, store)
        store.compact()
        store.vacuum()
    return _linked(store)


class _DiesBeforeWriting(PostStore):
    def upsert_tweets(self, analyzed, writer=None, batch=0):
        raise OSError("the driver's host is gone")


class _DiesAfterWriting(PostStore):
    def link_tweets(self, run_id, tweet_ids):
        raise OSError("the driver's host is gone")


def _crash(spark, sf_dir):
    """One stream dies before its posts are written, the other after, each then runs whole while
    the other's crash is not mended yet, with compactions in between."""
    root, landed = working_folder(spark, "store"), working_folder(spark, "landed")
    scraped, store = _scraped(spark, sf_dir), PostStore(spark, root)
    for part, dying in ((0, _DiesBeforeWriting), (1, _DiesAfterWriting)):
        scraped.filter(F.col("part") == part).select("value").write.text(f"{landed}/{part}")
        with contextlib.suppress(StreamingQueryException):
            _stream(spark, landed, part, dying(spark, root))
    store.compact()
    store.vacuum()
    for part in (1, 0):
        _stream(spark, landed, part, store)
        store.compact()
        store.vacuum()
    return _linked(store)


# Posts of the events in a store that saw older versions of them


def _stored_events(spark, sf_dir, buckets: int = 16) -> PostStore:
    """Every event's post, stored with wrong numbers first, compacted, and then put right."""
    store = PostStore(spark, working_folder(spark, "store"), buckets)
    posts = v.tweets(spark, sf_dir).withColumns(
        {
            "tokens": F.split("cleaned_text", " "),
            "lang": F.lit("en"),
            "raw_payload": F.lit("{}"),
            "ordinal": F.col("tweet_id").cast("long"),
        }
    )
    wrong = F.col("tweet_id").cast("long") % 3 == 0
    early = posts.withColumns(
        {
            "like_count": F.when(wrong, F.col("like_count") + 1000).otherwise(F.col("like_count")),
            "sentiment_label": F.when(wrong, "mixed").otherwise(F.col("sentiment_label")),
        }
    )
    store.upsert_tweets(early, "first")
    store.compact()
    store.upsert_tweets(posts.filter(wrong), "second")
    return store


def _touched_buckets(spark, sf_dir):
    """Posts after a small change, and whether just the changed posts' buckets were written anew."""
    store = _stored_events(spark, sf_dir, 64)
    store.compact()
    few = F.col("tweet_id").cast("long") % 500 == 7
    changed = store.tweets().filter(few).withColumns(
        {"like_count": F.col("like_count") + 5000, "ordinal": F.lit(0)}
    )
    store.upsert_tweets(changed, "third")
    store.compact()
    rows = store.merged_posts().select("tweet_id", "like_count", "fold", "bucket")
    buckets = rows.groupBy("bucket").agg(
        (F.bool_or(few) == (F.max("fold") == 3)).alias("as_touched"), F.count_distinct("fold").alias("folds")
    )
    return rows.join(buckets, "bucket").select("tweet_id", "like_count", "as_touched", "folds")


def _report(name: str, run_id: int):
    def query(spark, sf_dir):
        store = _stored_events(spark, sf_dir)
        for run in (1, 2, 3):
            opened = store.open_run(f"keyword={run}", "vader", "auto", "x_api")
            mine = v.links(spark, sf_dir).filter(F.col("run_id") == run)
            store.link_tweets(opened, mine.select("tweet_id"))
            store.complete_run(opened, run, run, "news_rss", True)
        return finish(jobs.run_report(store, run_id)[name])

    return query


def _details(spark, sf_dir):
    found = _report("details", 2)(spark, sf_dir)
    return found.drop("started_at", "completed_at", "raw_export_path", "processed_export_path", "error_message")


# Continuous forms over restarts


def _event_files(spark, sf_dir) -> tuple[str, DataFrame]:
    """The first twenty days of events in one folder of files, and all of them."""
    posts = v.tweets(spark, sf_dir).select(
        F.lit(1).cast("bigint").alias("run_id"), "tweet_id", "created_at", "sentiment_label", "sentiment_score"
    )
    return working_folder(spark, "events"), posts


def _late_rows(spark, sf_dir):
    """Hourly counts over two runs: the second brings newer posts, and late ones that are dropped."""
    landed, posts = _event_files(spark, sf_dir)
    late = F.col("tweet_id").cast("long") % 4 == 0
    old = F.col("created_at") < F.lit("2024-01-21").cast("timestamp")
    for part in (posts.filter(old & ~late), posts.filter(~old | late)):
        part.coalesce(1).write.mode("append").parquet(f"{landed}/in")
        source = spark.readStream.schema(posts.schema).parquet(f"{landed}/in")
        streams.store_series(source, "hourly", f"{landed}/out", f"{landed}/cp").awaitTermination()
    return finish(streams.read_series(spark, f"{landed}/out", "hourly"))


def _dedupe_restart(spark, sf_dir):
    """Copies of documents over two runs: ids still held are dropped again, expired ones pass."""
    landed = working_folder(spark, "posts")
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("tweet_id"), "doc_id")
    day = F.expr("timestamp'2026-05-01 00:00:00' + make_dt_interval(cast(doc_id % 10 AS int), if(doc_id % 10 = 9, 1, 0))")
    first = docs.select("tweet_id", day.alias("created_at"))
    again = docs.select("tweet_id", F.lit("2026-05-21 00:00:00").cast("timestamp").alias("created_at"))
    for part in (first.unionByName(first), again):
        part.coalesce(1).write.mode("append").parquet(f"{landed}/in")
        source = spark.readStream.schema(first.schema).parquet(f"{landed}/in")
        query = streams.first_per_id(source).writeStream.format("parquet").option(
            "checkpointLocation", f"{landed}/cp"
        ).trigger(availableNow=True).start(f"{landed}/out")
        query.awaitTermination()
    return finish(spark.read.schema(first.schema).parquet(f"{landed}/out"))


QUERIES = {
    "ingest_run": _ingest,
    "stream_ingest_two_runs": _two_streams,
    "stream_ingest_crash": _crash,
    "upsert_touched_buckets": _touched_buckets,
    "run_report_details": _details,
    "run_report_summary": _report("summary", 2),
    "run_report_series": _report("series", 2),
    "run_report_distribution": _report("distribution", 2),
    "run_report_sources": _report("sources", 3),
    "run_report_recent": _report("recent", 1),
    "stream_series_late_rows": _late_rows,
    "stream_dedupe_restart": _dedupe_restart,
}

_STREAMED = """
  SELECT CAST(doc_id % 2 + 1 AS BIGINT) AS run_id, CAST(doc_id AS VARCHAR) AS tweet_id,
         CAST(length(text) AS BIGINT) AS n_chars FROM documents"""

SQL = {
    "ingest_run": f"""
      WITH scored AS ({lexicon.SQL['lexicon_score']})
      SELECT CAST(d.doc_id AS VARCHAR) AS tweet_id, CAST(DATE '2026-05-01' + CAST(d.doc_id % 10 AS INTEGER) AS DATE) AS day,
             CAST(d.doc_id % 7 AS BIGINT) AS like_count, CAST(1 AS BIGINT) AS runs, label AS sentiment_label,
             round(score, 12) AS sentiment_score, round(confidence, 12) AS sentiment_confidence
      FROM documents d JOIN scored s ON s.doc_id = d.doc_id
      WHERE contains(lower(text), 'that') AND d.doc_id % 10 BETWEEN 2 AND 5
      ORDER BY d.doc_id LIMIT 100000""",
    "stream_ingest_two_runs": _STREAMED,
    "stream_ingest_crash": _STREAMED,
    "upsert_touched_buckets": f"""WITH {analytics.T_TWEETS}
      SELECT tweet_id, like_count + CASE WHEN CAST(tweet_id AS BIGINT) % 500 = 7 THEN 5000 ELSE 0 END AS like_count,
             true AS as_touched, CAST(1 AS BIGINT) AS folds FROM t_tweets""",
    "run_report_details": """
      SELECT CAST(2 AS BIGINT) AS id, 'keyword=2' AS source_query, 'vader' AS model_name, 'completed' AS status,
             CAST(2 AS BIGINT) AS total_collected, CAST(2 AS BIGINT) AS total_stored,
             'auto' AS requested_backend, 'x_api' AS resolved_backend, 'news_rss' AS served_backend,
             true AS fallback_used""",
    "run_report_summary": analytics.SQL["summary_stats_one_run"],
    "run_report_series": analytics.SQL["ts_hourly_gapfill_rolling"],
    "run_report_distribution": f"SELECT * FROM ({analytics.SQL['sentiment_distribution']}) WHERE run_id = 2",
    "run_report_sources": analytics.sources_sql(3, 20),
    "run_report_recent": analytics.recent_sql(1, 100),
    "stream_series_late_rows": analytics.late_rows_sql(),
    "stream_dedupe_restart": """
      SELECT CAST(doc_id AS VARCHAR) AS tweet_id,
             TIMESTAMP '2026-05-01' + to_days(CAST(doc_id % 10 AS INTEGER))
             + to_hours(CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) AS created_at FROM documents
      UNION ALL
      SELECT CAST(doc_id AS VARCHAR), TIMESTAMP '2026-05-21' FROM documents WHERE doc_id % 10 <= 7""",
}
