"""Hourly and daily sentiment series: buckets, gap filling, rolling mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posttide.functions.labels import LABELS, not_nan
from posttide.operators.linked import posts_of_runs

_UNITS = {"hourly": "hour", "daily": "day"}
COUNT_COLUMNS = ("total_tweets", "positive_count", "negative_count", "neutral_count")


def check_granularity(granularity: str) -> None:
    if granularity not in _UNITS:
        raise ValueError(f"unknown granularity {granularity!r}, expected one of {sorted(_UNITS)}")


def _unit(granularity: str) -> str:
    check_granularity(granularity)
    return _UNITS[granularity]


def period_of(created_at: Column, granularity: str) -> Column:
    return F.date_trunc(_unit(granularity), created_at)


def label_counts() -> list[Column]:
    """``<label>_count`` aggregates; other labels count in the total only."""
    return [
        F.count(F.when(F.col("sentiment_label") == label, 1)).alias(f"{label}_count")
        for label in reversed(LABELS)
    ]


def series_of(posts: DataFrame, granularity: str) -> DataFrame:
    """Series per run of posts that already carry ``run_id``."""
    return posts.groupBy(
        "run_id", period_of(F.col("created_at"), granularity).alias("period")
    ).agg(
        F.count(F.lit(1)).alias("total_tweets"),
        F.avg("sentiment_score").alias("average_sentiment"),
        *label_counts(),
    )


def sentiment_series(
    tweets: DataFrame, links: DataFrame, granularity: str, run_id: int | None = None
) -> DataFrame:
    """One row per run and period that holds posts."""
    _unit(granularity)
    posts = posts_of_runs(
        tweets, links, run_id, ["created_at", "sentiment_score", "sentiment_label"]
    )
    return series_of(posts, granularity)


def fill_gaps(
    series: DataFrame, granularity: str, fill_average: float | None = 0.0
) -> DataFrame:
    """Add the empty periods between a run's first and last one.

    Each period emits itself and the empty ones up to the next, so no calendar
    has to be joined. The window holds already aggregated rows, whose number is
    bounded by the periods of a run, not by its posts.
    """
    step = F.expr(f"INTERVAL 1 {_unit(granularity)}")
    following = F.lead("period").over(W.partitionBy("run_id").orderBy("period"))
    spread = series.withColumn("_next", following).withColumn(
        "_period",
        F.explode(
            F.when(
                F.col("_next").isNotNull(), F.sequence("period", F.col("_next") - step, step)
            ).otherwise(F.array("period"))
        ),
    )
    real = F.col("_period") == F.col("period")
    filled = {
        name: F.when(real, F.col(name)).otherwise(F.lit(0)).cast("bigint")
        for name in COUNT_COLUMNS
    }
    average = F.lit(fill_average).cast("double")
    filled["average_sentiment"] = F.coalesce(
        F.when(real, not_nan(F.col("average_sentiment"))), average
    )
    return spread.withColumns(filled).select(
        "run_id",
        F.col("_period").alias("period"),
        "total_tweets",
        "average_sentiment",
        "positive_count",
        "negative_count",
        "neutral_count",
    )


def rolling_average(
    series: DataFrame, window: int = 3, source_column: str = "average_sentiment"
) -> DataFrame:
    """Mean of the last ``window`` rows of a run; fewer at its start."""
    frame = W.partitionBy("run_id").orderBy("period").rowsBetween(-(window - 1), 0)
    return series.withColumn(
        "rolling_average", F.avg(not_nan(F.col(source_column))).over(frame)
    )


def trend(
    tweets: DataFrame,
    links: DataFrame,
    granularity: str,
    run_id: int | None = None,
    window: int = 3,
) -> DataFrame:
    """The charted series: buckets, then gaps, then the rolling mean."""
    series = sentiment_series(tweets, links, granularity, run_id)
    return rolling_average(fill_gaps(series, granularity), window)
