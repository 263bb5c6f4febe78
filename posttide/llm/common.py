"""What the operators share: written tables, hash-ordered prefix sums, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttide.session import shared_dir
from posttide.sources.tables import read_table

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# Rows that one slice of a hash-ordered group holds on average.
ROWS_PER_SLICE = 2_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; removed when the session's Python ends."""
    path = f"{shared_dir(spark)}/posttide-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session has gone, and with it the way to the store
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no more
    than the tasks it was running, and nothing is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_SLICE))


def slice_of(key: Column, n: int) -> Column:
    """Slice 0 to n - 1 of a uniform 64-bit key, ascending in the key read as unsigned."""
    return F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(n), 31)


def running_sums(
    rows: DataFrame, group: list[str], key: str, order: list[str], values: dict[str, Column], n: int
) -> DataFrame:
    """Add, for each name in ``values``, the sum over the rows before this one in its group.

    The group's order is the unsigned value of the uniform 64-bit column ``key``, then ``order``.
    Each group is cut into ``n`` slices of the key: the slices' sums are summed per group, the rows
    within their slice. So a group of any size is spread evenly, and no window sees more than one
    slice of rows or one group's list of slices.
    """
    rows = rows.withColumns(
        {"__slice": slice_of(F.col(key), n)} | {f"__v_{k}": v for k, v in values.items()}
    )
    keys = [*group, "__slice"]
    sums = rows.groupBy(*keys).agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in values],
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(F.shiftrightunsigned(key, 1), key, *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = [rows[k].eqNullSafe(starts[f"__k_{k}"]) for k in group] + [
        rows["__slice"] == starts["__k___slice"]
    ]
    joined = rows.join(starts, same)
    out = joined.withColumns(
        {
            k: F.col(f"__b_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0))
            for k in values
        }
    )
    return out.drop(
        *starts.columns, "__slice", *[f"__v_{k}" for k in values]
    )


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for jobs that run inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a few at a time: some are hundreds of times the usual length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def releasing(run):
    """A task function that gives its memory back when it ends.

    Worker processes outlive tasks and stages, and what they have freed would stay theirs: a stage
    would find the machine full of what earlier ones needed.
    """

    @wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return out
