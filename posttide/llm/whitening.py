"""Embedding whitening by shifted Cholesky QR.

Centred rows A are brought to A = Q R in passes over the rows: each sums the Gram matrix of the rows
under the factors so far, its Cholesky factor becomes the next R, and triangular solves apply it. The
first passes shift the Gram matrix by a little more than its rounding error, so that the factor exists
for any A; the later ones work on columns that are almost orthogonal, and lose no digits to the square
that a Gram matrix is. R's singular vectors are the components, its singular values their lengths.

Rows stay where they are: tasks send one Gram matrix each, as cells that Spark sums; the driver holds
matrices as wide as a vector and nothing that grows with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide.llm.common import stored

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
# Passes that shift, and those that follow.
SHIFTED, PLAIN = 2, 2
# Directions whose length is a smaller share of the longest are rounding errors: the passes leave a
# direction without extent at the square of the shift.
_NOTHING = 1e-11
_LONG = 1 << 63
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(64 c) + 1000000 of each entry; vectors without all entries finite are out."""
    parts = F.col("embedding").cast("array<double>")
    fine = F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter("embedding IS NOT NULL").filter(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(parts, lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"),
    )


def _numbers(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of so many numbers; shorter vectors count as filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    out = np.full((len(column), width), OFFSET, np.int64)
    for row, (a, b) in enumerate(zip(ends - ends[0], ends[1:] - ends[0], strict=False)):
        out[row, : b - a] = flat[a:b]
    return out


def _centred(column: pa.ListArray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n. The whole part of the mean goes first, so no digit is lost to the offset."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (_numbers(column, len(sums)) - whole).astype(float) - rest


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor, one after the other."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def _gram(rows: DataFrame, width: int, made) -> np.ndarray:
    """The sum of MᵀM over all blocks M = made(x) of rows, and their number of columns."""

    def cells(batches):
        total = np.zeros((width, width))
        for batch in batches:
            block = made(batch.column("x"))
            total += block.T @ block
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], ["cell", "value"]
        )

    summed = rows.select("x").mapInArrow(cells, "cell int, value double").groupBy("cell").agg(F.sum("value"))
    out = np.zeros(width * width)
    for cell, value in summed.collect():  # width * width rows
        out[cell] = value
    return out.reshape(width, width)


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, with so much more on its diagonal as it needs."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 100, np.finfo(float).eps * max(np.trace(gram), 1e-300))


def factors(rows: DataFrame, n: int, sums: list[int]) -> list[np.ndarray]:
    """The upper triangular R1, R2, .. of the passes; their product, last first, is R."""
    width, out = len(sums), []
    for turn in range(SHIFTED + PLAIN):
        gram = _gram(rows, width, lambda x: _solved(_centred(x, n, sums), out))
        shift = 100 * width * np.finfo(float).eps * np.trace(gram) if turn < SHIFTED else 0.0
        out = [*out, _factor(gram, shift)]
    return out


def components(rows: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``most`` unit components as columns, their eigenvalues, and their shares of the trace.

    Directions in which the vectors do not differ have no whitened coordinate and are left out. A
    component's largest entry is positive.
    """
    r = np.eye(len(sums))
    for factor in factors(rows, n, sums):
        r = factor @ r
    _, lengths, directions = np.linalg.svd(r)
    eigenvalues = lengths**2 / n
    kept = min(most, int((lengths > _NOTHING * lengths[0]).sum())) if lengths[0] > 0 else 0
    chosen = directions[:kept].T
    largest = np.abs(chosen).argmax(0)
    chosen = chosen * np.sign(chosen[largest, np.arange(kept)])
    return chosen, eigenvalues[:kept], eigenvalues[:kept] / max(eigenvalues.sum(), 1e-300)


def _deviations(column: pa.ListArray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S)² of each row, exact; null where it does not fit in 64 bits."""
    x = _numbers(column, len(sums))
    # n x - S = n (x - S // n) - S % n, with small numbers all along
    apart = x - np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    most = (max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0)))) + 1) * n
    if most**2 * max(1, len(sums)) < _LONG:
        return ((n * apart - rest) ** 2).sum(1).tolist()
    exact = ((n * apart.astype(object) - rest.astype(object)) ** 2).sum(1)
    return [v if v < _LONG else None for v in exact]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector: one row for each of its components.

    Returns vec_id, component, n, deviation, whitened, explained, identity_error. The fit and the
    result cover all vectors whose entries are all finite; the others are dropped, those with null
    vec_id or a vec_id that is there twice are not. Shorter vectors count as filled up with zeros.
    Components without extent (a dimension that never varies, or follows from others) are left out,
    so equal vectors only, one vector, or none, give an empty result. A deviation beyond 64 bits is
    null. Entries are taken up to 2^63 / 64.
    """
    rows = stored(whole_numbers(vectors), "vectors")
    spark = rows.sparkSession
    seen = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    n, width = seen[0], seen[1] or 0
    empty = spark.createDataFrame([], _OUT + ", identity_error double")
    if not width:
        return empty
    # The offset is taken out of each entry, so shorter vectors need not be filled up here.
    entries = rows.select(F.posexplode("x").alias("at", "v"))
    sums = [n * OFFSET] * width
    totals = entries.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)") - OFFSET))
    for at, total in totals.collect():  # one row for each dimension
        sums[at] += int(total)
    chosen, eigenvalues, shares = components(rows, n, sums, most)
    kept = len(eigenvalues)
    if not kept:
        return empty
    scaled = chosen / np.sqrt(eigenvalues)

    def coordinates(x: pa.ListArray) -> np.ndarray:
        return _centred(x, n, sums) @ scaled

    # A column of ones also sums the coordinates, which the covariance has to be centred by.
    gram = _gram(rows, kept + 1, lambda x: np.c_[coordinates(x), np.ones(len(x))])
    means = gram[:kept, kept] / n
    error = float(np.abs(gram[:kept, :kept] / n - np.outer(means, means) - np.eye(kept)).max())

    def expanded(batches):
        for batch in batches:
            x, rows = batch.column("x"), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()),
                    pa.array(np.full(rows * kept, n), pa.int64()),
                    pa.array([v for v in _deviations(x, n, sums) for _ in range(kept)], pa.int64()),
                    pa.array(coordinates(x).ravel()),
                    pa.array(np.tile(shares, rows)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(expanded, _OUT).withColumn("identity_error", F.lit(error))
