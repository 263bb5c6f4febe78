"""Best-fit packing in bulk-synchronous rounds: documents and gaps meet in sorted sweeps."""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttide.llm.common import releasing, small_batches, stored
from posttide.llm.tokens import encoder

LENGTH = 2048
END = 0
# Documents and gaps that one sweep task holds on average.
EVENTS_PER_TASK = 50_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Tokens of each document and its end token, longer ones cut from the back into full pieces."""

    def cut(batches):
        ids_of = encoder(path).ids
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(texts), strict=True):
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                edges = [0, *range(n % length or length, n + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), part if keep_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    small_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(cut), _PIECES)
    return out if keep_ids else out.drop("ids")


def _sweep(events: DataFrame, tasks: int) -> DataFrame:
    """Match, within each range of sizes, every document to the smallest gap open at its size.

    Events come from large to small, a gap before a document of its size. Gaps wait on a stack, so
    a document finds the smallest one that holds it, its successor among the gaps, and takes it
    alone: of documents that want the same gap the first in rank has it. What finds no partner in
    its range is numbered: documents in order, gaps in order.
    """

    def sweep(batches):
        part = TaskContext.get().partitionId()
        open_gaps: list[tuple[int, int, int]] = []
        docs = 0
        for batch in batches:
            out = []
            for kind, size, owner, ident in zip(
                *(batch.column(c).to_pylist() for c in ("kind", "size", "owner", "ident")), strict=True
            ):
                if kind:
                    open_gaps.append((size, owner, ident))
                elif open_gaps:
                    _, gap_owner, _ = open_gaps.pop()
                    out.append((part, 2, 0, ident, size, gap_owner))
                else:
                    out.append((part, 0, docs, ident, size, -1))
                    docs += 1
            yield _swept(out)
        for at in range(0, len(open_gaps), 10_000):
            left = open_gaps[at : at + 10_000]
            yield _swept([(part, 1, at + i, -1, g[0], g[1]) for i, g in enumerate(left)])

    order = [F.desc("size"), F.desc("kind"), F.xxhash64("owner", "ident"), F.col("owner"), F.col("ident")]
    spread = events.repartitionByRange(tasks, *order) if tasks > 1 else events.coalesce(1)
    return spread.sortWithinPartitions(*order).mapInArrow(
        sweep, "part int, state int, pos long, ident long, size long, owner long"
    )


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    names = ("part", "state", "pos", "ident", "size", "owner")
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
    )


def _across(spark: SparkSession, swept: DataFrame) -> DataFrame | None:
    """Matches between ranges: the same sweep over the ranges' counts, then a join by number.

    The counts are two numbers for each task of the sweep.
    """
    counts: dict[int, list[int]] = {}
    for row in swept.filter("state < 2").groupBy("part", "state").count().collect():
        counts.setdefault(row["part"], [0, 0])[row["state"]] = row["count"]
    waiting: list[list[int]] = []  # range, gaps still open
    runs, number = [], 0
    for part in sorted(counts):
        docs, gaps = counts[part]
        at = 0
        while at < docs and waiting:
            n = min(docs - at, waiting[-1][1])
            runs.append((0, part, at, at + n, number, 1))
            runs.append((1, waiting[-1][0], waiting[-1][1] - n, waiting[-1][1], number + n - 1, -1))
            at, number = at + n, number + n
            waiting[-1][1] -= n
            if not waiting[-1][1]:
                waiting.pop()
        if gaps:
            waiting.append([part, gaps])
    if not runs:
        return None
    spans = spark.createDataFrame(
        runs, "state int, part int, first long, past long, number long, step int"
    )
    numbered = (
        swept.filter("state < 2")
        .join(F.broadcast(spans), ["state", "part"])
        .filter("pos >= first AND pos < past")
        .withColumn("number", F.col("number") + F.col("step") * (F.col("pos") - F.col("first")))
    )
    docs = numbered.filter("state = 0").select("number", "ident", "size")
    gaps = numbered.filter("state = 1").select("number", "owner")
    return docs.join(gaps, "number").select("ident", "size", "owner")


def place(spark: SparkSession, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(ident, size) -> ident, size, owner, round: the sequence each item is put into.

    Sequences are opened as many as the tokens left need at least. In each round every gap offers
    itself, or as many equal slots as items of the largest size left would fill; documents and
    slots meet in sorted sweeps; gaps shrink; what found no slot stays for the next round.
    """
    todo = stored(items.select("ident", "size"), "items")
    gaps, opened, done, turn = None, 0, [], 0
    while True:
        left = todo.agg(
            F.count("*").alias("n"),
            F.sum("size").alias("tokens"),
            F.min("size").alias("least"),
            F.max("size").alias("most"),
        ).first()
        if not left["n"]:
            break
        turn += 1
        usable = 0
        if gaps is not None:
            gaps = gaps.filter(F.col("gap") >= left["least"])
            usable = gaps.count()
        if not usable or done and not done[-1][1]:
            more = math.ceil(left["tokens"] / length)
            fresh = spark.range(opened, opened + more).select(
                F.col("id").alias("owner"), F.lit(length).cast("long").alias("gap")
            )
            gaps = gaps.unionByName(fresh) if usable else fresh
            opened, usable = opened + more, usable + more
        slots = F.greatest(F.lit(1), F.floor(F.col("gap") / left["most"])).cast("long")
        offered = gaps.select(
            F.lit(1).alias("kind"),
            F.floor(F.col("gap") / slots).cast("long").alias("size"),
            "owner",
            F.explode(F.sequence(F.lit(1).cast("long"), slots)).alias("ident"),
        )
        wanted = todo.select(F.lit(0).alias("kind"), "size", F.lit(-1).cast("long").alias("owner"), "ident")
        tasks = math.ceil((left["n"] + usable) / EVENTS_PER_TASK)
        swept = stored(_sweep(wanted.unionByName(offered), tasks), "sweep")
        matched = swept.filter("state = 2").select("ident", "size", "owner")
        across = _across(spark, swept) if tasks > 1 else None
        if across is not None:
            across = stored(across, "across")
            matched = matched.unionByName(across)
        taken = matched.groupBy("owner").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
        gaps = stored(
            gaps.join(taken, "owner", "left").select(
                "owner", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")
            ),
            "gaps",
        )
        done.append((matched.withColumn("round", F.lit(turn)), matched.count()))
        rest = swept.filter("state = 0").select("ident", "size")
        if across is not None:
            rest = stored(rest.join(across.select("ident"), "ident", "left_anti"), "items")
        todo = rest
    out = items.select("ident", "size").limit(0).selectExpr("ident", "size", "0L AS owner", "0 AS round")
    for matched, _ in done:
        out = out.unionByName(matched)
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces, each with its sequence and its offset there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` where asked
    for. Null text is empty and still has its end token; repeated rows are packed each by itself.
    An empty table gives an empty result. No sequence is longer than ``length``.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, path, length, keep_ids)
    pieces = stored(pieces.withColumn("ident", F.monotonically_increasing_id()), "pieces")
    placed = place(spark, pieces.select("ident", F.col("length").alias("size")), length)
    order = Window.partitionBy("owner").orderBy("round", "ident")
    offset = F.sum("size").over(order) - F.col("size")
    located = placed.select("ident", F.col("owner").alias("sequence_id"), offset.alias("offset"))
    return pieces.join(located, "ident").drop("ident")
