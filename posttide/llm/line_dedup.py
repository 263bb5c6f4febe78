"""Reversible line de-duplication: sharded cuckoo filters backed by exact reference counts.

An index of lines has three tables. ``lines`` holds each line long enough as the hash of its key, its
document and its number. ``refs`` holds for each key how many lines refer to it, and the least and
greatest document. ``filters`` holds one cuckoo filter for each shard of the keys. A batch of
documents is counted first (hot keys combine inside the tasks) and meets the filters: keys that a
filter does not hold are new for certain and never meet ``refs``; the others are settled there
exactly. Removed documents give their references back; keys that nothing refers to any more leave
``refs`` and, as filters can forget, their filter. Every step returns a new index, so an older one
stays good.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.llm.common import slice_of, small_batches, stored
from posttide.llm.cuckoo import Cuckoo
from posttide.session import lookup_side

# Code points of the shortest key that counts.
SHORTEST = 10
# Keys that one shard holds, as a rule.
KEYS_PER_SHARD = 50_000
# Keys that more than one in so many lines refer to are hot; so there are fewer than that of them.
HOT = 10_000
# Batches that the documents of one call are taken in.
INCREMENTS = 2

_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["k1", "k2"]
_LINE = "k1 long, k2 long, doc_id long, t1 long, at int"
_REF = "k1 long, k2 long, refs long, unknown long, low long, high long"
_FILTER = "shard int, held long, slots binary, stash binary"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's hash, which tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text")).withColumn(
        "t1", F.xxhash64("text")
    )


def line_keys(docs: DataFrame) -> DataFrame:
    """Each line whose key is long enough: the key's two hashes, its document, its number."""
    lines = _named(docs).select("doc_id", "t1", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    bare = F.translate(F.btrim("line", F.lit(_SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = lines.select("doc_id", "t1", "at", bare.alias("key")).filter(F.length("key") >= SHORTEST)
    return keyed.select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), "doc_id", "t1", "at"
    )


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*_KEY).agg(
        F.count("*").alias("refs"),
        F.count_if(F.col("doc_id").isNull()).alias("unknown"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
    )


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    found = np.zeros(keys.num_rows, bool)
    for row in filters.to_pylist():
        found = Cuckoo.from_bytes(row["slots"], row["stash"]).holds(keys.column("k1").to_numpy())
    return pa.table({"k1": keys.column("k1"), "k2": keys.column("k2"), "maybe": pa.array(found)})


def _filter_row(shard: int, held: int, cuckoo: Cuckoo) -> pa.Table:
    slots, stash = cuckoo.to_bytes()
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "held": pa.array([held], pa.int64()),
            "slots": pa.array([slots], pa.binary()),
            "stash": pa.array([stash], pa.binary()),
        }
    )


def _grow(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The filter with the new keys; one that gets full is made anew from all keys of its shard."""
    if not keys.num_rows:
        return filters.select(["shard", "held", "slots", "stash"])
    k1, new = keys.column("k1").to_numpy(), keys.column("new").to_numpy(zero_copy_only=False)
    rows = filters.to_pylist()
    if rows and new.all():
        cuckoo, held = Cuckoo.from_bytes(rows[0]["slots"], rows[0]["stash"]), rows[0]["held"] + len(k1)
    else:
        cuckoo, held = Cuckoo.of_size(2 * len(k1)), len(k1)
    cuckoo.take(k1)
    return _filter_row(keys.column("shard")[0].as_py(), held, cuckoo)


def _shrink(keys: pa.Table, filters: pa.Table) -> pa.Table:
    if not keys.num_rows:
        return filters.select(["shard", "held", "slots", "stash"])
    row = filters.to_pylist()[0]
    cuckoo = Cuckoo.from_bytes(row["slots"], row["stash"])
    cuckoo.forget(keys.column("k1").to_numpy())
    return _filter_row(row["shard"], row["held"] - keys.num_rows, cuckoo)


@dataclass(frozen=True)
class LineIndex:
    """The lines of a set of documents; ``insert`` and ``remove`` return the index after it."""

    shards: int
    lines: DataFrame
    refs: DataFrame
    filters: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, shards: int) -> LineIndex:
        return cls(shards, *(spark.createDataFrame([], t) for t in (_LINE, _REF, _FILTER)))

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", slice_of(F.col("k1"), self.shards).cast("int"))

    def _with_filters(self, keys: DataFrame, step, schema: str) -> DataFrame:
        """``step`` on the keys and the filter of each shard."""
        pairs = self._sharded(keys).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return pairs.applyInArrow(step, schema)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents too."""
        return self._insert_lines(stored(line_keys(docs), "lines"))

    def _insert_lines(self, lines: DataFrame) -> LineIndex:
        fresh = stored(_counted(lines), "fresh")
        probed = stored(self._with_filters(fresh.select(*_KEY), _probe, "k1 long, k2 long, maybe boolean"), "probed")
        maybe = probed.filter("maybe").drop("maybe")
        seen = lookup_side(maybe)
        touched = self.refs.join(seen, _KEY, "left_semi").withColumn("old", F.lit(True))
        again = fresh.join(seen, _KEY, "left_semi").withColumn("old", F.lit(False))
        settled = touched.unionByName(again).groupBy(*_KEY).agg(
            *[F.sum(c).alias(c) for c in ("refs", "unknown")],
            F.min("low").alias("low"), F.max("high").alias("high"), (~F.bool_or("old")).alias("new"),
        )
        certain = fresh.join(seen, _KEY, "left_anti").withColumn("new", F.lit(True))
        untouched = self.refs.join(seen, _KEY, "left_anti").withColumn("new", F.lit(False))
        refs = stored(settled.unionByName(certain).unionByName(untouched), "refs")
        return LineIndex(self.shards, self.lines.unionByName(lines), refs.drop("new"), self._grown(refs))

    def _grown(self, refs: DataFrame) -> DataFrame:
        """Filters with the new keys. Shards that would get full, or have none, send all their keys."""
        slots = F.octet_length("slots") / 2
        known = self.filters.select("shard", "held", (slots * 0.8).cast("long").alias("capacity"))
        more = self._sharded(refs.filter("new")).groupBy("shard").count()
        fits = more.join(known, "shard").filter("held + count <= capacity").select("shard")
        fits = stored(fits.withColumn("fits", F.lit(True)), "fits")
        keys = self._sharded(refs.select("k1", "new")).join(lookup_side(fits), "shard", "left")
        sent = keys.filter("new OR fits IS NULL").select("k1", "new")
        return stored(self._with_filters(sent, _grow, _FILTER), "filters")

    def remove(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of these ids (column doc_id); unknown ids change nothing."""
        out = lookup_side(stored(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "ids"))
        same = self.lines["doc_id"].eqNullSafe(out["doc_id"])
        gone = self.lines.join(out, same, "left_semi")
        left = stored(self.lines.join(out, same, "left_anti"), "lines")
        keys = stored(gone.select(*_KEY).distinct(), "touched")
        touched = lookup_side(keys)
        recounted = stored(_counted(left.join(touched, _KEY, "left_semi")), "recounted")
        refs = stored(self.refs.join(touched, _KEY, "left_anti").unionByName(recounted), "refs")
        dead = keys.join(recounted.select(*_KEY), _KEY, "left_anti")
        filters = stored(self._with_filters(dead, _shrink, _FILTER), "filters")
        return LineIndex(self.shards, left, refs, filters)

    def dropped(self) -> DataFrame:
        """doc_id, t1 and the numbers of the lines that an earlier document (by id) has too."""
        shared = self.refs.filter("low < high OR (unknown > 0 AND low IS NOT NULL)")
        total = self.refs.agg(F.sum("refs")).first()[0] or 0
        wanted = shared.select(*_KEY, F.col("low"), (F.col("refs") > total / HOT).alias("hot"))
        hot = F.broadcast(wanted.filter("hot"))  # fewer than HOT rows
        lines = self.lines.join(hot, _KEY, "left")
        rest = lines.filter("hot IS NULL").drop("hot", "low").join(wanted.filter("NOT hot"), _KEY)
        out = lines.filter("hot").unionByName(rest).filter(~F.col("doc_id").eqNullSafe(F.col("low")))
        return out.groupBy("doc_id", "t1").agg(F.collect_set("at").alias("gone"))


def _without(text: str, gone: list[int] | None) -> tuple[int, int, str]:
    if not gone:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    away = set(gone)
    return len(lines), len(away), "\n".join([x for i, x in enumerate(lines) if i not in away])


def _kept(batches):
    for batch in batches:
        rows = [_without(t, g) for t, g in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True)]
        n_lines, n_dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in kept]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                pa.array(digests, pa.string()), pa.array(kept, pa.string()),
            ],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"],
        )


def index_of(docs: DataFrame, increments: int = INCREMENTS) -> LineIndex:
    """An index of all documents, inserted in so many batches."""
    spark = docs.sparkSession
    keys = line_keys(docs)
    batch = F.pmod(F.xxhash64("t1", "doc_id"), F.lit(increments))
    lines = stored(keys, "lines")
    index = LineIndex.empty(spark, 1 + lines.count() // KEYS_PER_SHARD)
    for i in range(increments):
        index = index._insert_lines(lines.filter(batch == i))
    return replace(index, lines=lines)


def keep_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """The documents (all of which the index holds) without the lines that it has from smaller ids."""
    small_batches(docs.sparkSession)
    named, gone = _named(docs), index.dropped().hint("merge")
    same = named["doc_id"].eqNullSafe(gone["doc_id"]) & (named["t1"] == gone["t1"])
    rows = named.join(gone, same, "left").select(named["doc_id"], named["text"], gone["gone"])
    return rows.mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")


def deduplicate(docs: DataFrame, increments: int = INCREMENTS) -> DataFrame:
    """Every document without the lines that a document with a smaller id has too.

    Returns doc_id, n_lines, n_dropped, kept_sha256 and ``kept``, the text that is left. Null and
    empty texts are one empty line. Rows that repeat an id are one document as owners of lines: none
    loses a line to another. Null ids are one document, after all others. Other columns are not
    carried. The result does not depend on the number of batches.
    """
    return keep_lines(docs, index_of(docs, increments))
