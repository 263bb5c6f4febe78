"""Keyed upsert, insert-or-ignore, run log folding, audits, cascade delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posttide import schemas
from posttide.session import lookup_side


def last_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key under ``order`` (a total order within a key).

    Each task first cuts its copies of a key to one, so a hot key is cheap.
    """
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return (
        rows.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, key: str = "tweet_id", order: str = "ordinal"
) -> DataFrame:
    """``existing`` with the rows of ``incoming`` put in or replaced; the last one wins.

    ``order`` numbers the incoming rows. Stored rows are only dropped by key:
    when the batch is counted to be small, its keys are broadcast and the stored
    side is neither sorted nor shuffled.
    """
    fresh = last_per_key(incoming, key, [order])
    keys = lookup_side(incoming.select(key).distinct())
    kept = existing.join(keys, key, "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def insert_or_ignore(
    existing: DataFrame, incoming: DataFrame, keys: list[str], value: str = "ingested_at"
) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet, one per key, earliest value."""
    new = incoming.groupBy(*keys).agg(F.min(value).alias(value))
    return new.join(existing.select(*keys), keys, "left_anti").select(*existing.columns)


def _latest(value: str, event: str | None = None) -> Column:
    """``value`` of the newest matching event; null when there is none.

    The value travels in the ordering struct, so that a null value counts too.
    """
    row = F.struct("event_seq", F.col(value).alias("value"))
    if event is not None:
        row = F.when(F.col("event") == event, row)
    return F.max(row)["value"]


def fold_runs(run_events: DataFrame) -> DataFrame:
    """State of every run from its open, complete and fail events.

    Completing sets totals, source and exports; failing sets the error and leaves
    them. Events of a run that was never opened change nothing.
    """
    opened = {
        name: _latest(name, "open")
        for name in ("source_query", "model_name", "requested_backend", "resolved_backend")
    }
    completed = {
        name: _latest(name, "complete")
        for name in (
            "total_collected", "total_stored", "served_backend", "fallback_used",
            "raw_export_path", "processed_export_path",
        )
    }
    status = _latest("event")
    started = F.max(F.when(F.col("event") == "open", F.col("event_at")))
    ended = F.max(
        F.when(F.col("event") != "open", F.struct("event_seq", "event_at"))
    )["event_at"]
    defaults = {
        "total_collected": F.lit(0).cast("bigint"),
        "total_stored": F.lit(0).cast("bigint"),
        "served_backend": F.lit("unknown"),
        "fallback_used": F.lit(False),
    }
    folded = run_events.groupBy(F.col("run_id").alias("id")).agg(
        *[c.alias(name) for name, c in opened.items()],
        *[
            F.coalesce(c, defaults[name]).alias(name) if name in defaults else c.alias(name)
            for name, c in completed.items()
        ],
        F.when(status == "complete", "completed")
        .when(status == "fail", "failed")
        .otherwise("running")
        .alias("status"),
        _latest("error_message", "fail").alias("error_message"),
        started.alias("started_at"),
        ended.alias("completed_at"),
    )
    return folded.filter(F.col("started_at").isNotNull()).select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.RUNS.fields]
    )


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs, by id."""
    return runs.orderBy(F.desc("id")).limit(limit)


def run_details(runs: DataFrame, run_id: int) -> DataFrame:
    """One run; no row when the id is unknown."""
    return runs.filter(F.col("id") == F.lit(run_id).cast("bigint"))


def run_history(runs: DataFrame) -> DataFrame:
    """Runs for display: times read leniently, a missing flag is false."""
    return runs.withColumns(
        {
            "started_at": F.try_to_timestamp(F.col("started_at").cast("string")),
            "completed_at": F.try_to_timestamp(F.col("completed_at").cast("string")),
            "fallback_used": F.coalesce(F.col("fallback_used").cast("boolean"), F.lit(False)),
        }
    )


def conform(table: DataFrame, name: str) -> DataFrame:
    """Add the columns later versions brought, with their defaults; never drop any."""
    missing = {
        column: F.lit(default).cast(kind)
        for column, (kind, default) in schemas.ADDED_COLUMNS[name].items()
        if column not in table.columns
    }
    return table.withColumns(missing) if missing else table


def null_violations(table: DataFrame, name: str) -> DataFrame:
    """Per required column, how many rows lack it: ``column, violations``; one pass."""
    required = [c for c in schemas.NOT_NULL[name] if c in table.columns]
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.unpivot([], required, "column", "violations").filter("violations > 0")


def key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, or are null: ``*keys, copies``."""
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return (
        table.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) | any_null)
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    parents = parent.select(F.col(parent_key).alias(column))
    return child.join(parents, column, "left_anti")


def delete_cascade(
    parent: DataFrame, links: DataFrame, key: str, link_key: str, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Parent and link tables without the keys in ``deleted`` (one column, ``key``)."""
    gone = lookup_side(deleted.select(key).distinct())
    link_gone = lookup_side(deleted.select(F.col(key).alias(link_key)).distinct())
    return parent.join(gone, key, "left_anti"), links.join(link_gone, link_key, "left_anti")
