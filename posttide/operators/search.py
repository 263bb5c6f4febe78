"""Search predicates, topic fan-out, first-seen de-duplication, source fallback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posttide.functions.text import WORD
from posttide.params import FALLBACK_SOURCE, RECENT_SOURCE, SearchParams
from posttide.session import cut_lineage


def _utc(day: date) -> Column:
    start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
    return F.lit(start).cast("timestamp")


def in_date_window(created_at: Column, start: date | None, end: date | None) -> Column:
    """UTC date within the bounds, both inclusive; a missing bound is open.

    Written as a range of instants, so that it reaches the scan as a filter.
    """
    inside = F.lit(True)
    if start is not None:
        inside = inside & (created_at >= _utc(start))
    if end is not None:
        inside = inside & (created_at < _utc(end + timedelta(days=1)))
    return inside


def has_tag(text: Column, tag: str) -> Column:
    """True when the text carries this whole hashtag, in any case."""
    not_word = WORD.replace("[", "[^", 1)
    return F.lower(text).rlike(rf"\Q{tag.lower()}\E(?:{not_word}|$)")


def matches_search(text: Column, created_at: Column, params: SearchParams) -> Column:
    """Keyword and all hashtags in the text, and the date inside the window."""
    params.validate()
    found = in_date_window(created_at, params.start_date, params.end_date)
    if params.term:
        found = found & F.contains(F.lower(text), F.lit(params.term.lower()))
    for tag in params.tags:
        found = found & has_tag(text, tag)
    return found


def in_recent_window(created_at: Column, params: SearchParams, now: datetime) -> Column:
    """Filter for a source that only keeps recent posts; a bad window is an error."""
    start, end = params.recent_bounds(now)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (created_at >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside = inside & (created_at < F.lit(end).cast("timestamp"))
    return inside


def matches_topic(folded: Column, variant: str) -> Column:
    """``a b`` needs every word, ``a OR b`` any part, of lower-cased text."""
    parts = variant.split(" OR ")
    found = F.lit(False)
    for part in parts:
        every = F.lit(True)
        for word in part.split():
            every = every & F.contains(folded, F.lit(word.lower()))
        found = found | every
    return found


def _matching_variants(folded: Column, params: SearchParams) -> Column:
    """Array of ``(query_idx, query)`` the lower-cased text matches, in fan-out order."""
    hits = [
        F.when(
            matches_topic(folded, variant),
            F.struct(F.lit(i).alias("query_idx"), F.lit(variant).alias("query")),
        )
        for i, variant in enumerate(params.topic_variants())
    ]
    return F.array_compact(F.array(*hits))


def topic_fanout(posts: DataFrame, params: SearchParams, text: str = "content") -> DataFrame:
    """One row per post and matching topic variant.

    The variants are a short list of settings, so they are tested inside the row.
    """
    folded = posts.withColumn("_folded", F.lower(text))
    hits = folded.withColumn("_hit", F.explode(_matching_variants(F.col("_folded"), params)))
    return hits.select(*posts.columns, "_hit.query_idx", "_hit.query")


def first_seen(
    posts: DataFrame,
    params: SearchParams,
    text: str = "content",
    item: str = "item_idx",
) -> DataFrame:
    """Posts in the order a fan-out over the variants would first meet them.

    Date filter, then one row per id, then the cap. A row is met first under its
    first matching variant, so the fan-out itself is never materialized; copies
    of an id are cut to one per task before the shuffle.
    """
    hits = _matching_variants(F.col("_folded"), params)
    met = (
        posts.filter(in_date_window(F.col("created_at"), params.start_date, params.end_date))
        .withColumn("_folded", F.lower(text))
        .withColumn("_hit", F.get(hits, F.lit(0)))
        .filter(F.col("_hit").isNotNull())
        .select(*posts.columns, "_hit.query_idx", "_hit.query")
    )
    order = [F.asc("query_idx"), F.asc(item)]
    kept = (
        met.withColumn("_rank", F.row_number().over(W.partitionBy("tweet_id").orderBy(*order)))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
    return cap_rows(kept, ["query_idx", item, "tweet_id"], params.max_results)


def chosen_posts(
    posts: DataFrame, params: SearchParams, served: str, now: datetime
) -> DataFrame:
    """The posts of one source that belong to the search, at most ``max_results`` of them.

    A feed is searched topic by topic; other sources by keyword and hashtags, and the one that
    keeps recent posts only also by its window. Filters come first, then one row per id, then the
    cap, all in the order of arrival. Sources that do not number their items go by file, date and
    id; every order ends in the row's hash, so that it is total.
    """
    arrival = [c for c in ("page_key", "item_idx") if c in posts.columns]
    marked = posts.withColumn("_hash", F.xxhash64(*posts.columns))
    order = [*arrival, "created_at", "tweet_id", "_hash"]
    if served == FALLBACK_SOURCE:
        hits = _matching_variants(F.lower("content"), params)
        found = marked.filter(
            in_date_window(F.col("created_at"), params.start_date, params.end_date)
        ).withColumn("_topic", F.get(hits, F.lit(0))["query_idx"])
        found, order = found.filter(F.col("_topic").isNotNull()), ["_topic", *order]
    else:
        found = marked.filter(matches_search(F.col("content"), F.col("created_at"), params))
        if served == RECENT_SOURCE:
            found = found.filter(in_recent_window(F.col("created_at"), params, now))
    met = W.partitionBy("tweet_id").orderBy(*order)
    first = found.withColumn("_rank", F.row_number().over(met)).filter(F.col("_rank") == 1).drop("_rank")
    return cap_rows(first, order, params.max_results).select(*posts.columns)


# Up to this cap a plain top-k is the cheapest plan: one task gets so many rows of each other task.
# Beyond it the same rows come from ranges; neither path promises an order of its output.
_SMALL_CAP = 1_000


def cap_rows(posts: DataFrame, order: list[str], max_results: int) -> DataFrame:
    """The first ``max_results`` rows under ``order``, which must be a total order.

    A large cap is cut per range partition: whole ranges below the cut pass, and
    only the range it falls into is ranked.
    """
    if max_results <= _SMALL_CAP:
        return posts.orderBy(*order).limit(max_results)
    if posts.count() <= max_results:
        return posts
    ranges = posts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = cut_lineage(ranges)
    passed, cut = 0, None
    for row in placed.groupBy("_range").count().orderBy("_range").collect():
        cut = row["_range"]
        if passed + row["count"] > max_results:
            break
        passed += row["count"]
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    below = placed.filter(F.col("_range") < cut)
    edge = placed.filter(F.col("_range") == cut).withColumn("_in_range", rank)
    edge = edge.filter(F.col("_in_range") <= max_results - passed).drop("_in_range")
    return below.unionByName(edge).drop("_range")


def _served(df: DataFrame, requested: str, resolved: str, served: str) -> DataFrame:
    return df.withColumns(
        {
            "requested_backend": F.lit(requested),
            "resolved_backend": F.lit(resolved),
            "served_backend": F.lit(served),
            "fallback_used": F.lit(served != resolved),
        }
    )


def first_nonempty(
    primary: DataFrame,
    fallback: DataFrame,
    requested: str,
    resolved: str,
    key: str = "run_id",
) -> DataFrame:
    """Per run: the primary rows if there are any, else the fallback rows.

    Primary rows pass through without a shuffle; only their distinct keys meet
    the fallback rows, in an anti-join.
    """
    taken = _served(primary, requested, resolved, resolved)
    if resolved == FALLBACK_SOURCE:
        return taken
    spare = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return taken.unionByName(_served(spare, requested, resolved, FALLBACK_SOURCE))


def batch_provenance(runs: DataFrame, chosen: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run: what served it and how many rows it got.

    A run that got nothing was last asked of the fallback, and says so.
    """
    per_run = chosen.groupBy(key).agg(
        F.count(F.lit(1)).alias("collected"), F.max("served_backend").alias("_served")
    )
    resolved = F.col("resolved_backend")
    served = F.coalesce("_served", F.lit(FALLBACK_SOURCE))
    return (
        runs.select(key, "requested_backend", "resolved_backend")
        .join(per_run, key, "left")
        .select(
            key,
            "requested_backend",
            "resolved_backend",
            served.alias("served_backend"),
            (served != resolved).alias("fallback_used"),
            F.coalesce("collected", F.lit(0)).cast("bigint").alias("collected"),
        )
    )


@dataclass(frozen=True)
class Batch:
    """Posts of one run and where they came from."""

    posts: DataFrame
    requested_backend: str
    resolved_backend: str
    served_backend: str

    @property
    def fallback_used(self) -> bool:
        return self.served_backend != self.resolved_backend


def fetch_batch(
    readers: dict[str, Callable[[], DataFrame]], requested: str, resolved: str
) -> Batch:
    """Read the resolved source; if it fails or is empty, read the fallback.

    A source is read to its end and kept before it counts, so that a failure in its last partition
    brings the fallback too. When the fallback is empty, an error of the resolved source is raised.
    """
    names = [resolved] + ([FALLBACK_SOURCE] if resolved != FALLBACK_SOURCE else [])
    failed: Exception | None = None
    batch = None
    for name in names:
        last = name == names[-1]
        try:
            posts = cut_lineage(readers[name]())
            empty = posts.isEmpty()
        except Exception as exc:
            if last:
                raise
            failed = exc
            continue
        batch = Batch(posts, requested, resolved, name)
        if not empty:
            return batch
    if failed is not None:
        raise failed
    return batch
