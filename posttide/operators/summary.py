"""Label distribution and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posttide.functions.labels import safe_float
from posttide.operators.linked import posts_of_runs


def share_of_total(count: str, group: list[str]) -> Column:
    """Percentage of ``count`` within its group; 0.0 when the group sums to zero."""
    total = F.sum(count).over(W.partitionBy(*group))
    return F.when(total > 0, F.col(count) / total * 100.0).otherwise(F.lit(0.0))


def sentiment_distribution(
    tweets: DataFrame, links: DataFrame, run_id: int | None = None
) -> DataFrame:
    """Posts per label: ``run_id, label, count``."""
    posts = posts_of_runs(tweets, links, run_id, ["sentiment_label"])
    return posts.groupBy("run_id", F.col("sentiment_label").alias("label")).agg(
        F.count(F.lit(1)).alias("count")
    )


def distribution_frame(distribution: DataFrame) -> DataFrame:
    """Add ``percentage``, most frequent first; the window holds one row per label of a run."""
    shares = distribution.withColumn("percentage", share_of_total("count", ["run_id"]))
    return shares.orderBy("run_id", F.desc("count"), F.asc("label"))


def _by_label(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial results per label, from which one more small step makes the summary."""
    return posts.groupBy(*keys, F.col("sentiment_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("sentiment_score").alias("n_score"),
        F.sum("sentiment_score").alias("sum_score"),
        F.count("sentiment_confidence").alias("n_confidence"),
        F.sum("sentiment_confidence").alias("sum_confidence"),
        F.min("created_at").alias("earliest"),
        F.max("created_at").alias("latest"),
    )


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.sum(total), F.sum(n))


def _base_stats() -> list[Column]:
    return [
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_tweets"),
        _mean("sum_score", "n_score").alias("average_sentiment"),
        _mean("sum_confidence", "n_confidence").alias("average_confidence"),
        F.min("earliest").alias("earliest_tweet"),
        F.max("latest").alias("latest_tweet"),
    ]


def _label_stats() -> list[Column]:
    def share(label: str) -> Column:
        hits = F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(F.lit(0)))
        return F.coalesce(F.try_divide(hits * 100.0, F.sum("n")), F.lit(0.0))

    # Highest count wins; equal counts go to the label first in the alphabet.
    best = F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label")))
    return [
        share("positive").alias("positive_percentage"),
        share("negative").alias("negative_percentage"),
        share("neutral").alias("neutral_percentage"),
        F.coalesce(best, F.lit("neutral")).alias("dominant_sentiment"),
    ]


_STAT_INPUTS = ["sentiment_label", "sentiment_score", "sentiment_confidence", "created_at"]


def summary_stats(
    tweets: DataFrame, links: DataFrame, run_id: int | None = None
) -> DataFrame:
    """Count, averages and time span; a run without posts still gives one row."""
    posts = posts_of_runs(tweets, links, run_id, _STAT_INPUTS)
    if run_id is not None:
        return _by_label(posts, []).agg(*_base_stats())
    return _by_label(posts, ["run_id"]).groupBy("run_id").agg(*_base_stats())


def run_summary(
    tweets: DataFrame,
    links: DataFrame,
    run_id: int | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Summary with label percentages and the dominant label, in one pass over posts.

    For all runs, pass ``runs`` to keep those that stored nothing.
    """
    posts = posts_of_runs(tweets, links, run_id, _STAT_INPUTS)
    stats = [*_base_stats(), *_label_stats()]
    if run_id is not None:
        result = _by_label(posts, []).agg(*stats)
    else:
        result = _by_label(posts, ["run_id"]).groupBy("run_id").agg(*stats)
        if runs is not None:
            ids = runs.select(F.col("id").alias("run_id")).distinct()
            result = ids.join(result, "run_id", "left")
    zero = F.lit(0.0)
    return result.withColumns(
        {
            "total_tweets": F.coalesce("total_tweets", F.lit(0)).cast("bigint"),
            "average_sentiment": safe_float(F.col("average_sentiment")),
            "average_confidence": safe_float(F.col("average_confidence")),
            "positive_percentage": F.coalesce("positive_percentage", zero),
            "negative_percentage": F.coalesce("negative_percentage", zero),
            "neutral_percentage": F.coalesce("neutral_percentage", zero),
            "dominant_sentiment": F.coalesce("dominant_sentiment", F.lit("neutral")),
        }
    )
