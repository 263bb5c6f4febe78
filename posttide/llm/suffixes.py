"""Suffix ranks over content-picked positions: bytes covered by strings that occur twice.

Prefix doubling ranks every position by the bytes behind it, at growing lengths, and lets go of
positions whose rank is unique. Here the positions are anchors (``posttide.llm.anchors``): each
string of ``LENGTH`` bytes has exactly one, and equal strings have equal ones, so that one position
in about 80 stands for all. Anchors are ranked by ``GRAM`` bytes, those still tied by all bytes of
their strings, and those tied at the first length but not at the second string by string. Ranks
are 64-bit hashes under the rank before, counted by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide.llm import anchors as an
from posttide.llm.common import releasing, small_batches, stored
from posttide.session import lookup_side

LENGTH, GRAM = 200, 32
# Texts that share an anchor are compared in memory up to this many different surroundings; beyond
# it their strings are counted by Spark one by one.
TOGETHER = 20_000

_TEXT_KEY = ["h1", "h2"]
_ANCHOR = "h1 long, h2 long, anchor int, first int, last int, key long, context long"
_BODY = "key long, many boolean, h1 long, h2 long, anchor int, first int, last int, body binary"
_SPAN = "h1 long, h2 long, first int, past int"


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``__row``, its text's bytes, and two hashes that name the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
        text.cast("binary").alias("__text"),
    )


def _batch(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], list(columns))


_LONG, _INT = pa.int64(), pa.int32()
_TYPES = {"h1": _LONG, "h2": _LONG, "anchor": _INT, "first": _INT, "last": _INT, "past": _INT, "key": _LONG, "context": _LONG}


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(x).to_numpy() for x in _TEXT_KEY)
            found = []
            for i, text in enumerate(batch.column("__text").to_pylist()):
                if len(text) >= length:
                    got = an.anchors(np.frombuffer(text, np.uint8), length, gram)
                    found.append((np.full(len(got[0]), h1[i]), np.full(len(got[0]), h2[i]), *got))
            if found:
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                columns[5:] = [x.view(np.int64) for x in columns[5:]]
                yield _batch(dict(zip(list(_TYPES)[:5] + ["key", "context"], columns, strict=True)), _TYPES)

    return texts.select(*_TEXT_KEY, "__text").mapInArrow(releasing(run), _ANCHOR)


def _bodies(texts: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """The bytes of the strings around each anchor in ``need``, from one copy of each text."""
    items = need.groupBy(*_TEXT_KEY).agg(
        F.collect_list(F.struct("key", "many", "anchor", "first", "last")).alias("items")
    )
    wanted = lookup_side(need.select(*_TEXT_KEY).distinct())
    once = texts.select(*_TEXT_KEY, "__text").join(wanted, _TEXT_KEY, "left_semi")
    joined = once.dropDuplicates(_TEXT_KEY).join(items, _TEXT_KEY)

    def run(batches):
        names = ["key", "many", "h1", "h2", "anchor", "first", "last", "body"]
        types = [_LONG, pa.bool_(), _LONG, _LONG, _INT, _INT, _INT, pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                text, items = row["__text"], row["items"]
                for at in range(0, len(items), 2000):
                    part = items[at : at + 2000]
                    rows = [
                        (x["key"], x["many"], row["h1"], row["h2"], x["anchor"], x["first"], x["last"], text[x["first"] : x["last"] + length])
                        for x in part
                    ]
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return joined.mapInArrow(releasing(run), _BODY)


def _strings(batch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all strings of all rows: row, start within its text, and a rank under key and distance."""
    bodies = batch.column("body").to_pylist()
    sizes = np.array([len(x) for x in bodies], np.int64)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(bodies)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    sums, inverse = an.prefix_hashes(np.frombuffer(b"".join(bodies), np.uint8))
    at = begin[row] + inside
    hashes = an.span_hashes(sums, inverse, at, at + length)
    first, anchor, key = (batch.column(x).to_numpy() for x in ("first", "anchor", "key"))
    start = first[row] + inside
    under = an.mixed(key.view(np.uint64)[row] + (anchor[row] - start).astype(np.uint64))
    return row, start, an.mixed(hashes ^ under)


def _runs(batch, row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of neighbouring strings of a row, as spans of bytes."""
    breaks = np.flatnonzero((np.diff(row) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(row)]]) - 1
    if not len(row):
        first = last = np.zeros(0, np.int64)
    of = row[first]
    columns = {x: batch.column(x).to_numpy()[of] for x in _TEXT_KEY}
    return _batch({**columns, "first": start[first], "past": start[last] + length}, _TYPES)


def _together(bodies: DataFrame, length: int) -> DataFrame:
    """Compare the strings of rows with the same key, key after key in sorted order."""

    def compared(batch) -> pa.RecordBatch:
        row, start, rank = _strings(batch, length)
        many = batch.column("many").to_numpy(zero_copy_only=False)[row]
        _, which = np.unique(rank, return_inverse=True)
        twice = np.bincount(which, 1 + many)[which] >= 2
        kept = twice & ~many
        return _runs(batch, row[kept], start[kept], length)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            keys = table.column("key").to_numpy()
            done = int(np.searchsorted(keys, keys[-1]))
            whole = table.to_batches()[0]
            held = whole.slice(done)
            if done:
                yield compared(whole.slice(0, done))
        if held is not None:
            yield compared(held)

    tasks = max(1, bodies.sparkSession.sparkContext.defaultParallelism)
    spread = bodies.repartition(4 * tasks, "key").sortWithinPartitions("key")
    return spread.mapInArrow(releasing(run), _SPAN)


def _one_by_one(bodies: DataFrame, length: int) -> DataFrame:
    """The same for keys of too many surroundings: every string is a row, counted by rank."""

    def run(batches):
        for batch in batches:
            row, start, rank = _strings(batch, length)
            columns = {x: batch.column(x).to_numpy()[row] for x in _TEXT_KEY}
            many = batch.column("many").to_numpy(zero_copy_only=False)[row]
            out = _batch({**columns, "first": start, "key": rank.view(np.int64)}, _TYPES)
            yield out.append_column("many", pa.array(many))

    rows = bodies.mapInArrow(releasing(run), "h1 long, h2 long, first int, key long, many boolean")
    rows = stored(rows, "strings")
    twice = rows.groupBy("key").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).filter("n > 1")
    kept = rows.filter("NOT many").join(twice, "key", "left_semi")
    return kept.select(*_TEXT_KEY, "first", (F.col("first") + length).alias("past"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """(h1, h2, spans): the byte spans of each text that has any, sorted."""
    found = stored(_anchors(texts, length, gram), "anchors")
    ties = found.groupBy("key").count().filter("count > 1").select("key")
    tied = stored(found.join(ties, "key", "left_semi"), "tied")
    place = F.struct("h1", "h2", "anchor", "first", "last")
    ranks = stored(tied.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(place).alias("one")), "ranks")
    whole = tied.join(ranks.filter("n > 1"), ["key", "context"], "left_semi").select(
        *_TEXT_KEY, "first", (F.col("last") + length).alias("past")
    )
    split = ranks.groupBy("key").count().filter("count > 1")
    need = ranks.join(split, "key").select("key", (F.col("n") > 1).alias("many"), "count", "one.*")
    need = stored(need, "need")
    some = stored(_bodies(texts, need.filter(F.col("count") <= together), length), "bodies")
    spans = whole.unionByName(_together(some, length))
    if not need.filter(F.col("count") > together).isEmpty():
        rest = _bodies(texts, need.filter(F.col("count") > together), length)
        spans = spans.unionByName(_one_by_one(rest, length))
    listed = spans.distinct().groupBy(*_TEXT_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "past"))).alias("spans"))
    return listed


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans:
        if out and x["first"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["past"]))
        else:
            out.append((x["first"], x["past"]))
    return out


def _cut(docs: DataFrame, length: int, gram: int, together: int) -> DataFrame:
    """Each row as ``__row``, with the counts and what is kept."""
    small_batches(docs.sparkSession)
    texts = _keyed(docs)
    spans = stored(repeated_spans(texts, length, gram, together), "spans")
    keys = lookup_side(spans.select(*_TEXT_KEY))
    rest = texts.join(keys, _TEXT_KEY, "left_anti").select(
        "__row",
        F.octet_length("__text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("__text", 256).alias("kept_sha256"),
        F.col("__text").alias("kept"),
    )

    def cut(batches):
        for batch in batches:
            counts, out = [], []
            rows = zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            for text, spans in rows:
                merged = _merged(spans)
                edges = [0, *[x for span in merged for x in span], len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                counts.append((len(text), len(text) - len(left), len(merged)))
                out.append(left)
            numbers = [pa.array([c[k] for c in counts], _LONG) for k in range(3)]
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), *numbers, shas, pa.array(out, pa.binary())],
                ["__row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    hit = texts.join(keys, _TEXT_KEY, "left_semi").join(spans, _TEXT_KEY).select("__row", "__text", "spans")
    kind = texts.schema["__row"].dataType.simpleString()
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return hit.mapInArrow(releasing(cut), f"__row {kind}, {more}").unionByName(rest)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """The columns of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes).

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in
    the same document or another; all copies go, the first too. Strings are judged on the input.
    Null text is empty; texts shorter than ``length`` stay whole; repeated rows are copies of each
    other and lose everything if long enough. An empty table gives an empty result. Columns of
    ``docs`` with the new names are replaced.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    others = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return _cut(docs, length, gram, together).select(*others, *new)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of ``docs`` with the repeated bytes cut from text; no row goes.

    Where a cut falls inside a character, what is left of it becomes the replacement character.
    """
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    columns = [text if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return _cut(docs, length, GRAM, TOGETHER).select(*columns)
