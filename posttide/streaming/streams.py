"""Streaming forms: file ingest by upsert, event-time series, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from posttide import schemas
from posttide.operators.series import check_granularity, fill_gaps, label_counts, rolling_average
from posttide.plans.scorers import Scorer, analyze
from posttide.session import bucketed_while
from posttide.sinks.store import PostStore, writer_name
from posttide.sources.posts import posts_from_scraped

_SERIES_COLUMNS = (
    "total_tweets", "average_sentiment", "positive_count", "negative_count", "neutral_count",
)
_WIDTHS = {"hourly": "1 hour", "daily": "1 day"}


def scraped_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Posts from JSON-lines files as they land in ``folder``."""
    return posts_from_scraped(spark.readStream.schema(schemas.SCRAPED_POST).json(folder))


def ingest_stream(
    posts: DataFrame, store: PostStore, scorer: Scorer, run_id: int, checkpoint: str
) -> StreamingQuery:
    """Upsert and link each micro-batch, then stop when all landed files are read.

    A stream is known by its checkpoint and writes under that name and the micro-batch's number, so
    one that is replayed replaces its own rows and nobody else's. Other streams, jobs and a
    compaction may use the store meanwhile.
    """
    writer = writer_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Numbered once and written, so that scores come to the posts and posts need not move.
        numbered = batch.withColumn("ordinal", F.monotonically_increasing_id())
        with bucketed_while(numbered, "ordinal") as posts:
            store.upsert_tweets(analyze(posts, scorer), writer, batch_id)
            store.link_tweets(run_id, posts.select("tweet_id"))

    return (
        posts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def series_stream(posts: DataFrame, granularity: str, delay: str = "1 hour") -> DataFrame:
    """Hourly or daily buckets per run; posts later than ``delay`` are dropped.

    ``posts`` carries ``run_id``. Gaps are filled when the result is read.
    """
    check_granularity(granularity)
    window = F.window("created_at", _WIDTHS[granularity])
    return (
        posts.withWatermark("created_at", delay)
        .groupBy("run_id", window.alias("_window"))
        .agg(
            F.count(F.lit(1)).alias("total_tweets"),
            F.avg("sentiment_score").alias("average_sentiment"),
            *label_counts(),
        )
        .select(
            "run_id",
            F.col("_window.start").alias("period"),
            "total_tweets",
            "average_sentiment",
            "positive_count",
            "negative_count",
            "neutral_count",
        )
    )


def store_series(
    posts: DataFrame, granularity: str, folder: str, checkpoint: str, delay: str = "1 hour"
) -> StreamingQuery:
    """Keep the series of a stream below ``folder``, then stop when all landed files are read.

    State lasts over runs with one checkpoint: a later run goes on counting open periods, and drops
    posts of periods that the watermark has closed. Each micro-batch writes the periods it changed,
    as a partition of its own that a replay overwrites; ``read_series`` takes the newest of each.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        placed = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        placed.partitionBy("batch").parquet(folder)

    return (
        series_stream(posts, granularity, delay).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_series(spark: SparkSession, folder: str, granularity: str, window: int = 3) -> DataFrame:
    """The stored series with its gaps filled and its rolling mean."""
    newest = F.struct("batch", *[F.col(c) for c in _SERIES_COLUMNS])
    last = spark.read.parquet(folder).groupBy("run_id", "period").agg(F.max(newest).alias("_last"))
    series = last.select("run_id", "period", *[F.col(f"_last.{c}").alias(c) for c in _SERIES_COLUMNS])
    return rolling_average(fill_gaps(series, granularity), window)


def first_per_id(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeated ids that arrive within ``delay`` of the first."""
    return posts.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["tweet_id"])
