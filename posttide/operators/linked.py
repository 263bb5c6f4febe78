"""Posts joined to the runs that collected them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posts_of_runs(
    tweets: DataFrame, links: DataFrame, run_id: int | None, columns: list[str]
) -> DataFrame:
    """``run_id, tweet_id`` and the given post columns, one row per link.

    The run filter sits on the links, where it prunes partitions. ``tweet_id``
    is unique in ``tweets``, so a post linked by very many runs only makes one
    side of the join hot, which adaptive execution splits.
    """
    chosen = links.select("run_id", "tweet_id")
    if run_id is not None:
        chosen = chosen.filter(F.col("run_id") == F.lit(run_id).cast("bigint"))
    return chosen.join(tweets.select("tweet_id", *columns), "tweet_id")
