"""Stored posts, links and runs as Parquet tables.

``changes`` holds every upsert as rows, partitioned by who wrote them and by the writer's batch; a
repeated micro-batch overwrites its own partition and no other. ``posts`` holds the current state,
partitioned by a hash of the key; ``compact`` merges changes into the buckets they touch and writes
those anew, under the next fold number. ``folds`` says, in one file a fold, which buckets it wrote and
which batches it took in: a fold counts once that file is there, so a crash at any point loses
nothing and repeats nothing. Any number of streams and jobs may write; one compacts at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide import schemas
from posttide.operators import state
from posttide.session import cut_lineage, lookup_side
from posttide.sinks import paths

# Buckets of the posts of a new store; a store keeps the number it began with.
BUCKETS = 64

# About so many rows are merged by one task, and written to one file of a bucket.
_PART_ROWS = 4_000
_CODEC = "zstd"

_BATCH = ["writer", "batch"]
_ORDER = ["stored_at", "writer", "batch", "ordinal"]
_CHANGES = T.StructType(
    [
        *schemas.TWEETS.fields,
        T.StructField("ordinal", T.LongType()),
        T.StructField("stored_at", T.TimestampType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)
_FOLDS = "fold long, buckets int, bucket int, writer string, batch long"


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0)


def writer_name(stream: str) -> str:
    """The name that a stream, known by its checkpoint, writes under."""
    return hashlib.sha256(stream.encode()).hexdigest()[:24]


def _packed(tokens: Column) -> tuple[Column, Column]:
    """Tokens as one text where that loses nothing, and otherwise as they are: arrays take several
    times the room of their text in a shuffle or a sort."""
    joined = F.array_join(tokens, " ")
    whole = F.coalesce(F.split(joined, " ") == tokens, F.lit(False))
    return F.when(whole, joined), F.when(~whole, tokens)


def storage_row(analyzed: DataFrame, updated_at: datetime) -> DataFrame:
    """Analyzed posts in the stored schema (times cut to seconds), plus ``ordinal``."""
    stamped = analyzed.withColumns(
        {
            "created_at": F.date_trunc("second", "created_at"),
            "updated_at": F.lit(updated_at).cast("timestamp"),
        }
    )
    return stamped.select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.TWEETS.fields],
        F.col("ordinal").cast("long").alias("ordinal"),
    )


class PostStore:
    """Read and write the three stored tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._new_buckets = buckets

    # Posts

    def _changes_path(self) -> str:
        return f"{self.root}/changes"

    def _posts_path(self, fold: int, bucket: int | None = None) -> str:
        folder = f"{self.root}/posts/fold={fold}"
        return folder if bucket is None else f"{folder}/bucket={bucket}"

    def _folds(self) -> DataFrame:
        path = f"{self.root}/folds"
        if not paths.exists(self.spark, path):
            return self.spark.createDataFrame([], _FOLDS)
        return self.spark.read.schema(_FOLDS).parquet(path)

    def _newest_folds(self) -> tuple[dict[int, int], int, int]:
        """The fold that wrote each bucket last, the number of buckets, and the last fold."""
        written = self._folds().filter("bucket IS NOT NULL").groupBy("bucket", "buckets")
        rows = written.agg(F.max("fold").alias("fold")).collect()  # one row a bucket
        buckets = rows[0]["buckets"] if rows else self._new_buckets
        newest = {r["bucket"]: r["fold"] for r in rows}
        return newest, buckets, max(newest.values(), default=0)

    def merged_posts(self, newest: dict[int, int] | None = None) -> DataFrame:
        """What folds have merged, with the ``fold`` and ``bucket`` of each row's file."""
        newest = self._newest_folds()[0] if newest is None else newest
        if not newest:
            return self.spark.createDataFrame([], schemas.TWEETS).selectExpr("*", "0 AS fold", "0 AS bucket")
        folders = [self._posts_path(fold, bucket) for bucket, fold in newest.items()]
        return self.spark.read.option("basePath", f"{self.root}/posts").parquet(*folders)

    def _posts(self, newest: dict[int, int]) -> DataFrame:
        """The merged rows of these buckets."""
        return state.conform(self.merged_posts(newest), "tweets").select(*schemas.TWEETS.names)

    def _pending(self) -> DataFrame | None:
        """Changes that no fold has taken in; None when there never was one."""
        if not paths.exists(self.spark, self._changes_path()):
            return None
        changes = self.spark.read.schema(_CHANGES).parquet(self._changes_path())
        taken = self._folds().filter("writer IS NOT NULL").select(*_BATCH)
        return changes.join(lookup_side(taken), _BATCH, "left_anti")

    def tweets(self) -> DataFrame:
        """Current state: one row per ``tweet_id``."""
        base, pending = self._posts(self._newest_folds()[0]), self._pending()
        if pending is None:
            return base
        return state.upsert(base, pending.withColumn("ordinal", F.struct(*_ORDER)))

    def _first_stored(self, writer: str, batch: int) -> datetime | None:
        """When a batch that is there, whole or in part, was stored first."""
        path = f"{self._changes_path()}/writer={writer}/batch={batch}"
        if not paths.exists(self.spark, path):
            return None
        rows = self.spark.read.schema(_CHANGES).parquet(path)
        return rows.agg(F.min("stored_at")).first()[0]

    def upsert_tweets(self, analyzed: DataFrame, writer: str | None = None, batch: int = 0) -> int:
        """Store analyzed posts; returns how many were given, copies included.

        A batch given again, by the same writer under the same number, takes the place it had
        among other writers' batches; one that is merged already is not written again.
        """
        writer = uuid.uuid4().hex if writer is None else writer
        same = (F.col("writer") == writer) & (F.col("batch") == batch)
        if not self._folds().filter(same).isEmpty():
            return analyzed.count()
        at = self._first_stored(writer, batch) or datetime.now(timezone.utc)
        rows = storage_row(analyzed, utc_now()).withColumns(
            {
                "stored_at": F.lit(at).cast("timestamp"),
                "writer": F.lit(writer),
                "batch": F.lit(batch).cast("long"),
            }
        )
        placed = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        placed.option("compression", _CODEC).partitionBy(*_BATCH).parquet(self._changes_path())
        path = f"{self._changes_path()}/writer={writer}/batch={batch}"
        return self.spark.read.schema(_CHANGES).parquet(path).count() if paths.exists(self.spark, path) else 0

    def compact(self) -> None:
        """Merge pending changes into the buckets they touch; other buckets' files stay.

        Rows move once, to the part of a bucket their key belongs to, and are merged and written
        there. They lie in the order of their time inside a file, so a filter on ``created_at``
        skips most of its row groups.
        """
        pending = self._pending()
        if pending is None:
            return
        batches = cut_lineage(pending.select(*_BATCH).distinct())
        if batches.isEmpty():
            return
        newest, buckets, last = self._newest_folds()
        bucket = F.pmod(F.xxhash64("tweet_id"), F.lit(buckets)).cast("int")
        rows = pending.join(lookup_side(batches), _BATCH, "left_semi")
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most ``buckets``
        base = self._posts({b: newest[b] for b in touched if b in newest})
        total = rows.count() + base.count()
        parts = total // (buckets * _PART_ROWS) + 1
        part = F.pmod(F.hash("tweet_id"), F.lit(parts))
        both = rows.withColumn("_new", F.lit(True)).unionByName(base, allowMissingColumns=True)
        joined, array = _packed(F.col("tokens"))
        packed = both.withColumns({"bucket": bucket, "_part": part, "_joined": joined, "tokens": array})
        placed = packed.repartition(total // _PART_ROWS + 1, "bucket", "_part")
        newest_first = W.partitionBy("bucket", "_part", "tweet_id").orderBy(
            F.desc_nulls_last("_new"), *[F.desc(c) for c in _ORDER]
        )
        # Stored rows without a key are nobody's older version.
        kept = (F.col("_rank") == 1) | (F.col("_new").isNull() & F.col("tweet_id").isNull())
        merged = placed.withColumn("_rank", F.row_number().over(newest_first)).filter(kept)
        ordered = merged.select(*schemas.TWEETS.names, "_joined", "bucket").sortWithinPartitions("bucket", "created_at")
        tokens = F.coalesce(F.split("_joined", " "), "tokens")
        fold = last + 1
        ordered.withColumn("tokens", tokens).drop("_joined").write.mode("overwrite").option(
            "compression", _CODEC
        ).partitionBy("bucket").parquet(self._posts_path(fold))
        wrote = self.spark.createDataFrame([(fold, buckets, b, None, None) for b in touched], _FOLDS)
        took = batches.select(
            F.lit(fold).cast("long").alias("fold"), F.lit(buckets).alias("buckets"),
            F.lit(None).cast("int").alias("bucket"), *_BATCH,
        )
        wrote.unionByName(took).coalesce(1).write.mode("append").parquet(f"{self.root}/folds")

    def vacuum(self) -> None:
        """Remove what compactions have replaced. Frames read before must not be used after."""
        newest, _, last = self._newest_folds()
        for fold in range(1, last + 1):
            for entry in paths.entries(self.spark, self._posts_path(fold)):
                name, _, bucket = entry.name.partition("=")
                if name == "bucket" and newest.get(int(bucket)) != fold:
                    paths.remove(self.spark, entry.path)
        taken = self._folds().filter("writer IS NOT NULL").select(*_BATCH)
        for row in taken.toLocalIterator():
            paths.remove(self.spark, f"{self._changes_path()}/writer={row['writer']}/batch={row['batch']}")

    # Links, one folder per run

    def _links(self) -> str:
        return f"{self.root}/links"

    def links(self) -> DataFrame:
        runs = [e.path for e in paths.entries(self.spark, self._links()) if e.is_dir]
        if not runs:
            return self.spark.createDataFrame([], schemas.LINKS)
        stored = self.spark.read.schema(schemas.LINKS).parquet(self._links())
        return stored.select(*schemas.LINKS.names)

    def link_tweets(self, run_id: int, tweet_ids: DataFrame) -> None:
        """Link posts to a run; links that exist stay as they are."""
        incoming = tweet_ids.select(
            F.lit(run_id).cast("bigint").alias("run_id"),
            "tweet_id",
            F.lit(utc_now()).cast("timestamp").alias("ingested_at"),
        )
        existing = self.links().filter(F.col("run_id") == run_id)
        new = state.insert_or_ignore(existing, incoming, ["run_id", "tweet_id"])
        new.write.mode("append").partitionBy("run_id").parquet(self._links())

    # Run log, one small file per status change

    def _events(self) -> str:
        return f"{self.root}/run_events"

    def run_events(self) -> DataFrame:
        if not paths.exists(self.spark, self._events()):
            return self.spark.createDataFrame([], schemas.RUN_EVENTS)
        return self.spark.read.schema(schemas.RUN_EVENTS).parquet(self._events())

    def runs(self) -> DataFrame:
        return state.fold_runs(self.run_events())

    def _log(self, run_id: int, event: str, **fields) -> None:
        seen = self.run_events().filter(F.col("run_id") == run_id)
        seq = seen.agg(F.max("event_seq")).first()[0] or 0
        row = {"run_id": run_id, "event": event, "event_seq": seq + 1, "event_at": utc_now()}
        row.update(fields)
        values = tuple(row.get(name) for name in schemas.RUN_EVENTS.names)
        one = self.spark.createDataFrame([values], schemas.RUN_EVENTS).coalesce(1)
        one.write.mode("append").parquet(self._events())

    def open_run(
        self, source_query: str, model_name: str, requested_backend: str, resolved_backend: str
    ) -> int:
        """Log a new run and return its id, the highest so far plus one."""
        run_id = (self.run_events().agg(F.max("run_id")).first()[0] or 0) + 1
        self._log(
            run_id,
            "open",
            source_query=source_query,
            model_name=model_name,
            requested_backend=requested_backend,
            resolved_backend=resolved_backend,
        )
        return run_id

    def complete_run(
        self,
        run_id: int,
        total_collected: int,
        total_stored: int,
        served_backend: str,
        fallback_used: bool,
        raw_export_path: str | None = None,
        processed_export_path: str | None = None,
    ) -> None:
        self._log(
            run_id,
            "complete",
            total_collected=total_collected,
            total_stored=total_stored,
            served_backend=served_backend,
            fallback_used=fallback_used,
            raw_export_path=raw_export_path,
            processed_export_path=processed_export_path,
        )

    def fail_run(self, run_id: int, error_message: str) -> None:
        self._log(run_id, "fail", error_message=error_message)
