"""Posts, links and runs derived from the driver's ``events`` and ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.sources.tables import read_table, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts, spread for CPU-bound work."""
    return spread(read_table(spark, f"{sf_dir}/{name}.parquet", list(columns)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored post per event."""
    label = (
        F.when(F.col("event_type").isin("purchase", "signup"), "positive")
        .when(F.col("event_type") == "error", "negative")
        .otherwise("neutral")
    )
    signed = (
        F.when(label == "positive", F.col("value") / 500.0)
        .when(label == "negative", -F.col("value") / 500.0)
        .otherwise(0.0)
    )
    user = F.col("user_id").cast("string")
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("tweet_id"),
        F.concat(F.lit("user_"), user).alias("username"),
        F.concat(F.lit("User "), (F.col("user_id") % 20).cast("string")).alias("display_name"),
        F.date_trunc("second", "ts").alias("created_at"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.concat(F.lit("https://x.com/user_"), user).alias("url"),
        F.lower("event_type").alias("cleaned_text"),
        label.alias("sentiment_label"),
        signed.alias("sentiment_score"),
        (0.5 + F.col("value") / 1000.0).alias("sentiment_confidence"),
        F.get_json_object("props", "$.k").cast("bigint").alias("like_count"),
        (F.col("event_id") % 7).cast("bigint").alias("retweet_count"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 1 links every post, run 2 the purchases, run 3 purchases, views and clicks."""
    runs = F.array_compact(
        F.array(
            F.lit(1).cast("bigint"),
            F.when(F.col("event_type") == "purchase", F.lit(2).cast("bigint")),
            F.when(F.col("event_type").isin("purchase", "view", "click"), F.lit(3).cast("bigint")),
        )
    )
    return events(spark, sf_dir).select(
        F.explode(runs).alias("run_id"),
        F.col("event_id").cast("string").alias("tweet_id"),
        F.date_trunc("second", "ts").alias("ingested_at"),
    )
