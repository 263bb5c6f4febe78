"""Token ids of a corpus as binary files, and their reader.

A shard is two files. ``<name>.ids`` holds the ids of its documents one after another, as unsigned
little-endian integers of 2 or 4 bytes. ``<name>.idx`` holds the magic bytes, the id width and the
number of documents without a doc_id, then two Elias-Fano codes: where each document ends in the
array, and the doc_ids. Shards and documents are in ascending doc_id order, nulls first. The folder
``manifest`` lists the shards that count, as Parquet.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttide.llm import elias_fano
from posttide.llm.common import releasing, small_batches
from posttide.llm.tokens import encoder

END = 1
MAGIC = b"PTTOK01\n"
_HEAD = "<8sBQ"
# Ids that the reader holds at once, beyond one document.
_READ_IDS = 1 << 20

_MANIFEST = "shard int, name string, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Encode every document and write the files; returns the manifest.

    A task writes under names of its own attempt, so a task that runs again, or twice at once,
    never touches a file that counts. Null text is empty and still has its end token. Rows that
    repeat an id follow each other. An empty table writes a manifest without rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def write(batches):
        coder = encoder(path)
        kind = "<u2" if coder.size <= 1 << 16 else "<u4"
        tail = end.to_bytes(4, "little")
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        doc_ids, lengths, out = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{root}/{name}.ids")
            doc_ids += batch.column("doc_id").to_pylist()
            for ids in coder.ids([x or "" for x in batch.column("text").to_pylist()]):
                coded = np.frombuffer(ids + tail, "<u4").astype(kind)
                lengths.append(len(coded))
                out.write(coded.tobytes())
        if out is None:
            return
        out.close()
        nulls = sum(x is None for x in doc_ids)
        ends = np.cumsum(lengths)
        with fs.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(struct.pack(_HEAD, MAGIC, int(kind[-1]), nulls))
            index.write(elias_fano.encode(ends))
            index.write(elias_fano.encode(np.asarray(doc_ids[nulls:], np.int64)))
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "shard": context.partitionId(),
                    "name": name,
                    "n_docs": len(doc_ids),
                    "n_ids": int(ends[-1]),
                }
            ],
            pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(releasing(write), _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class Shard:
    """One shard's files."""

    def __init__(self, folder: str, name: str):
        fs, root = _open(folder)
        with fs.open_input_file(f"{root}/{name}.idx") as file:
            data = file.read()
        magic, width, self._nulls = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is no index of this format")
        self.ends = elias_fano.Decoder(data, struct.calcsize(_HEAD))
        self.keys = elias_fano.Decoder(data, struct.calcsize(_HEAD) + self.ends.size)
        self._file = fs.open_input_file(f"{root}/{name}.ids")
        self._kind, self._width = f"<u{width}", width

    def doc_ids(self) -> list[int | None]:
        return [None] * self._nulls + self.keys.values().tolist()

    def span(self, first: int, past: int) -> np.ndarray:
        self._file.seek(first * self._width)
        return np.frombuffer(self._file.read((past - first) * self._width), self._kind)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select alone."""
        return self.span(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def blocks(self):
        """(doc_ids, starts, ends, ids) of runs of documents, a bounded number of ids each."""
        keys, ends = self.doc_ids(), self.ends.values()
        starts = np.concatenate([[0], ends[:-1]])
        at = 0
        while at < len(keys):
            past = max(at + 1, int(np.searchsorted(ends, starts[at] + _READ_IDS, "right")))
            yield keys[at:past], starts[at:past], ends[at:past], self.span(starts[at], ends[past - 1])
            at = past


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for keys, starts, ends, ids in Shard(folder, row["name"]).blocks():
                    wide = ids.astype("<u4").tobytes()
                    spans = zip((4 * (starts - starts[0])).tolist(), (4 * (ends - starts[0])).tolist(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64()),
                            pa.array(starts + row["base"], pa.int64()),
                            pa.array(ends - starts, pa.int64()),
                            pa.array([zlib.crc32(wide[a:b]) for a, b in spans], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return listed.repartitionByRange(4 * tasks, "shard").mapInArrow(read, _DOCS)
