"""Session settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only when it has at most this many rows.
BROADCAST_MAX_ROWS = 500_000

# Bytes of a batch that goes to Python; there it takes several times as much.
ARROW_BATCH = "4m"


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on (time zone), what skew handling needs (AQE), and how much text a
    Python worker is handed at once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh folder; a cluster without
    it is an error, because executors could not read a machine-local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="posttide-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; removed when the session's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session has gone, and with it the way to the store
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and no task's memory holds it."""
    path = working_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_bucketed(df: DataFrame, key: str) -> tuple[str, str]:
    """The name and the folder of a new table of ``df``, bucketed by ``key``."""
    spark = df.sparkSession
    path = working_folder(spark, "bucketed")
    name = "posttide_" + path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return name, path


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``.

    Writing it shuffles nothing, and a join on ``key`` afterwards moves the other side only.
    """
    return df.sparkSession.table(_write_bucketed(df, key)[0])


@contextlib.contextmanager
def bucketed_while(df: DataFrame, key: str):
    """``bucketed`` inside the block; the table and its files are gone after it, however it ends."""
    spark = df.sparkSession
    name, path = _write_bucketed(df, key)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, path)


def lookup_side(
    df: DataFrame, rows: int | None = None, max_rows: int = BROADCAST_MAX_ROWS
) -> DataFrame:
    """Hint a broadcast when ``df`` is counted to be small; else leave a shuffle join.

    Pass ``rows`` when the count is known; otherwise it is taken here, stopping
    after ``max_rows + 1`` rows.
    """
    if rows is None:
        rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df
