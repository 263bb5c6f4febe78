"""Top-k by group, source rankings and recent posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posttide.functions.labels import engagement, safe_float
from posttide.functions.text import or_default
from posttide.operators.linked import posts_of_runs

# Up to this k Spark itself cuts each map task to k rows per group before the shuffle.
_MAP_SIDE_K = 1000
_SALTS = 256


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, spread: list[str]
) -> DataFrame:
    """The first ``k`` rows of each group under ``order`` (a total order).

    Below ``_MAP_SIDE_K`` the rank filter is also applied map-side, so one hot
    group never reaches a single task whole. Above it the group is first ranked
    in slices taken from the hash of the ``spread`` columns.
    """
    if k > _MAP_SIDE_K:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(_SALTS)))
        within = W.partitionBy(*group, "_slice").orderBy(*order)
        df = (
            sliced.withColumn("_rank", F.row_number().over(within))
            .filter(F.col("_rank") <= k)
            .drop("_rank", "_slice")
        )
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


_SOURCE_KEYS = ("display_name", "username")


def _source_order() -> list[Column]:
    return [
        F.desc("tweet_count"),
        F.desc("average_sentiment"),
        F.asc("display_name"),
        F.asc("username"),
    ]


def source_breakdown(
    tweets: DataFrame, links: DataFrame, run_id: int | None = None, limit: int = 15
) -> DataFrame:
    """Most active sources of one run, or of every run when ``run_id`` is None."""
    posts = posts_of_runs(
        tweets,
        links,
        run_id,
        [
            "display_name", "username", "created_at", "sentiment_score",
            "sentiment_confidence", "like_count", "retweet_count",
        ],
    )
    sources = posts.groupBy("run_id", *_SOURCE_KEYS).agg(
        F.count(F.lit(1)).alias("tweet_count"),
        F.avg("sentiment_score").alias("average_sentiment"),
        F.avg("sentiment_confidence").alias("average_confidence"),
        F.avg(engagement(F.col("like_count"), F.col("retweet_count"))).alias(
            "average_engagement"
        ),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    if run_id is not None:
        return sources.orderBy(*_source_order()).limit(limit)
    return top_per_group(sources, ["run_id"], _source_order(), limit, list(_SOURCE_KEYS))


def source_breakdown_frame(sources: DataFrame) -> DataFrame:
    """Fill gaps of a source ranking and put it in order."""
    return sources.withColumns(
        {
            "tweet_count": F.coalesce("tweet_count", F.lit(0)).cast("bigint"),
            "average_sentiment": safe_float(F.col("average_sentiment")),
            "average_confidence": safe_float(F.col("average_confidence")),
            "average_engagement": safe_float(F.col("average_engagement")),
        }
    ).orderBy(*_source_order())


def source_chart_feed(sources: DataFrame, limit: int = 10) -> DataFrame:
    """The top sources, smallest first, with the name to show for each."""
    top = sources.orderBy(*_source_order()).limit(limit)
    return top.withColumn(
        "source_label", or_default(F.col("display_name"), F.col("username"))
    ).orderBy(F.asc("tweet_count"), F.desc("display_name"), F.desc("username"))


RECENT_COLUMNS = (
    "tweet_id", "created_at", "username", "display_name", "content", "url", "cleaned_text",
    "sentiment_label", "sentiment_score", "sentiment_confidence", "like_count",
    "retweet_count",
)


# Days behind the newest post that are looked at first, next, and so on, before all are.
_STRETCHES = (1, 8, 64, 512, 4096)
_DAY = 86_400_000_000


def _recent_enough(tweets: DataFrame, links: DataFrame, run_id: int, limit: int) -> DataFrame:
    """Posts of the shortest stretch, back from the newest, that holds ``limit`` of the run.

    The filter on ``created_at`` reaches the scan, where posts stored in the order of time are
    skipped by row group; old posts are read only when the new ones do not suffice.
    """
    latest = tweets.agg(F.max(F.unix_micros("created_at"))).first()[0]
    if latest is None:
        return tweets
    for days in _STRETCHES:
        recent = tweets.filter(F.col("created_at") >= F.timestamp_micros(F.lit(latest - days * _DAY)))
        if posts_of_runs(recent, links, run_id, []).limit(limit).count() == limit:
            return recent
    return tweets


def recent_posts(
    tweets: DataFrame, links: DataFrame, run_id: int | None = None, limit: int = 100
) -> DataFrame:
    """Newest posts of one run, or of every run when ``run_id`` is None.

    The ranking reads ids and times only; the wide text columns are fetched
    afterwards for the rows that won.
    """
    order = [F.desc("created_at"), F.asc("tweet_id")]
    if run_id is not None:
        tweets = _recent_enough(tweets, links, run_id, limit)
    narrow = posts_of_runs(tweets, links, run_id, ["created_at"])
    if run_id is not None:
        winners = narrow.orderBy(*order).limit(limit)
    else:
        winners = top_per_group(narrow, ["run_id"], order, limit, ["tweet_id"])
    wide = tweets.select(*RECENT_COLUMNS)
    if run_id is not None and limit <= 100_000:
        # At most ``limit`` rows: a broadcast keeps the text from being shuffled.
        winners = F.broadcast(winners.select("run_id", "tweet_id"))
    else:
        winners = winners.select("run_id", "tweet_id")
    found = wide.join(winners, "tweet_id").select("run_id", *RECENT_COLUMNS)
    return found.orderBy(*order) if run_id is not None else found
