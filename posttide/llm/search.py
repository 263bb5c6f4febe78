"""Exact top-k search by integer inner product, a block of documents at a time under bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttide.llm.common import batches_of, stored

K, SCALE = 20, 64
# Vectors whose neighbourhoods order the others: so many, those with the least hash of their id.
PIVOTS = 64
# Vectors of a document range, of a block in it, and queries of a group.
RANGE, BLOCK, QUERIES = 4096, 128, 1024

_EXACT, _LONG = 1 << 53, 1 << 63


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(64 x) of each component; vectors without all components finite are out."""
    parts = F.col("embedding").cast("array<double>")
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(fine)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(parts, lambda x: F.floor(x * SCALE)).cast("array<bigint>").alias("vec"),
    )


def _matrix(rows: list[bytes]) -> np.ndarray:
    """One row for each vector, shorter ones filled up with zeros."""
    width = max(map(len, rows), default=0)
    data = b"".join(x.ljust(width, b"\0") for x in rows)
    return np.frombuffer(data, np.int64).reshape(len(rows), width // 8)


def _packed(data: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it, under their width: it goes to many places."""
    least, most = int(data.min(initial=0)), int(data.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return bytes([kind().itemsize]) + data.astype(kind).tobytes()


def _unpacked(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(packed, f"i{packed[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number type in which every sum is exact."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    bound = most[0] * most[1] * max(1, a.shape[1])
    return np.float64 if bound < _EXACT else np.int64 if bound < _LONG else object


def _bounded(scores: np.ndarray) -> np.ndarray:
    """Beyond 64 bits a score stops at the ends of their range."""
    return np.clip(scores, -_LONG, _LONG - 1) if scores.dtype == object else scores


def search_range(
    queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the up to ``k`` best of one document range: (query's index, ids, scores).

    ``docs`` are in ascending order of ids inside blocks only. A block's bound sums, over the
    components, the larger of query times block maximum and query times block minimum. Every query
    goes through the blocks by falling bound, and stops at the first below its floor: the k-th
    score known for it, from here or from elsewhere.
    """
    queries, docs = _same_width(queries, docs)
    kind = _kind(queries, docs)
    queries, docs = queries.astype(kind), docs.astype(kind)
    starts = np.arange(0, len(docs), BLOCK)
    top, low = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _bounded(plus @ top.T + minus @ low.T)
    order = np.argsort(-bounds.astype(float), axis=1, kind="stable")
    floors = floors.astype(kind)
    best = [(np.zeros(0, np.int64), np.zeros(0, kind)) for _ in query_ids]
    active = np.arange(len(query_ids))
    for turn in range(len(starts)):
        block_of = order[active, turn]
        active = active[bounds[active, block_of] >= floors[active]]
        if not len(active):
            break
        block_of = order[active, turn]
        for block in np.unique(block_of):
            rows = active[block_of == block]
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            scores = _bounded(queries[rows] @ docs[part].T)
            reach = scores >= floors[rows][:, None]
            reach &= ids[part][None, :] != query_ids[rows][:, None]
            for i in np.flatnonzero(reach.any(1)):
                row, hit = rows[i], np.flatnonzero(reach[i])
                found = np.concatenate([best[row][0], ids[part][hit]])
                values = np.concatenate([best[row][1], scores[i][hit]])
                if len(found) > k:
                    kept = np.lexsort((found, -values))[:k]
                    found, values = found[kept], values[kept]
                    floors[row] = max(floors[row], values[-1])
                best[row] = (found, values)
    return [(i, found, values.astype(np.int64)) for i, (found, values) in enumerate(best) if len(found)]


def _with_region(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, vec as bytes, and the pivot whose direction is nearest: any rule gives right results,
    a good one gives tight blocks."""
    lengths = np.maximum(1e-9, np.sqrt((pivots.astype(float) ** 2).sum(1)))

    def assign(batches):
        for batch in batches:
            rows = [np.asarray(x, np.int64).tobytes() for x in batch.column("vec").to_pylist()]
            data, centers = _same_width(_matrix(rows), pivots)
            near = (data.astype(float) @ centers.astype(float).T / lengths).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(rows, pa.binary())],
                ["vec_id", "region", "vec"],
            )

    return vectors.mapInArrow(assign, "vec_id long, region int, vec binary")


def _grouped(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a region cut by hash into groups of about ``size``: group, region, ids, vecs."""
    counts = rows.groupBy("region").count().collect()  # at most PIVOTS rows
    cuts = [1] * PIVOTS
    for r in counts:
        cuts[r["region"]] = max(1, math.ceil(r["count"] / size))
    first = [0, *np.cumsum(cuts).tolist()]
    table = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(n).alias("n")) for a, n in zip(first, cuts, strict=False)])
    at = F.get(table, "region")
    group = at["first"] + F.pmod(F.xxhash64("vec_id", "vec"), at["n"])

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vecs = table.column("vec").to_pylist()
        ids = table.column("vec_id").to_numpy()
        data = _matrix(vecs)
        return pa.table(
            {
                "group": table.column("group")[:1],
                "region": table.column("region")[:1],
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vecs": pa.array([_packed(data)], pa.binary()),
            }
        )

    cut = rows.select(group.cast("int").alias("group"), "region", "vec_id", "vec")
    return cut.groupBy("group").applyInArrow(gather, "group int, region int, ids binary, vecs binary")


def _searched(row: dict, k: int):
    """The ids of a query group, and what one document range holds for it."""
    query_ids, ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
    queries, docs = _unpacked(row["q_vecs"], len(query_ids)), _unpacked(row["vecs"], len(ids))
    floors = np.frombuffer(row["floors"], np.int64) if "floors" in row else np.full(len(query_ids), -_LONG)
    return query_ids, search_range(queries, query_ids, floors, docs, ids, k)


def _with_floors(pairs: DataFrame, k: int) -> DataFrame:
    """Each query group with the k-th best score that one range holds for each of its queries."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, found = _searched(row, k)
                floors = np.full(len(query_ids), -_LONG)
                for i, ids, scores in found:
                    if len(ids) == k:
                        floors[i] = scores.min()
                kept = {x: [row[x]] for x in ("q_ids", "q_vecs")} | {"floors": [floors.tobytes()]}
                yield pa.RecordBatch.from_pydict(kept, pa.schema([(x, pa.binary()) for x in kept]))

    return pairs.mapInArrow(run, "q_ids binary, q_vecs binary, floors binary")


def _found(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) that each pair of a query group and a document range yields."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, found = _searched(row, k)
                if not found:
                    continue
                sizes = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids[[i for i, *_ in found]], sizes)),
                        pa.array(np.concatenate([ids for _, ids, _ in found])),
                        pa.array(np.concatenate([scores for *_, scores in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The ``k`` best vectors of every query: query_id, rank, vec_id, score.

    Queries are searched first in one range of their own region, which gives each a floor, then in
    all ranges above that floor. Candidates are all rows but those with the query's own vec_id;
    ties go to the smaller vec_id; a vec_id that is there twice is two candidates, and one query.
    Vectors that are null, or hold a null or non-finite component, take no part; shorter vectors
    count as filled up with zeros. Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors)
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    if not seeds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = _matrix([np.asarray(r["vec"], np.int64).tobytes() for r in seeds])
    placed = stored(_with_region(rows, pivots), "vectors")
    ranges = stored(_grouped(placed, RANGE), "ranges")
    asked = _grouped(placed.filter(is_query).dropDuplicates(["vec_id"]), QUERIES)
    groups = stored(
        asked.select(F.col("region"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")),
        "queries",
    )
    own = ranges.groupBy("region").agg(F.min("group").alias("group"))
    # Never broadcast: Spark takes either side for small, as it sees packed files before they are exploded.
    docs = ranges.drop("region").hint("merge")
    first = groups.join(own, "region").drop("region").join(docs, "group")
    with batches_of(spark, 8):  # a row holds a whole group and a whole range
        floored = stored(_with_floors(first, k), "floors")
    last = ranges.agg(F.max("group")).first()[0]
    everywhere = floored.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(last))))
    with batches_of(spark, 8):
        found = stored(_found(everywhere.join(docs, "group"), k), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
