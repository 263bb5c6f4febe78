"""Labeled CSV files: discovery, reading, skipping what cannot be used."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.operators.corpus import label_columns, merge_frames, require_two_labels, training_frame
from posttide.session import lookup_side
from posttide.sinks import paths

# Different headers that the files of one corpus may have.
MAX_HEADERS = 100

# The texts a CSV reader takes for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def training_paths(
    spark: SparkSession,
    explicit: str | None,
    configured: str | None,
    processed_dir: str | None,
) -> list[str]:
    """An explicit file alone; else the configured one, then exports, newest first."""
    if explicit is not None:
        return [paths.resolve(spark, explicit)]
    found = []
    if configured and paths.exists(spark, configured):
        found.append(paths.resolve(spark, configured))
    exports = [e for e in paths.entries(spark, processed_dir or "") if e.name.endswith(".csv")]
    exports.sort(key=lambda e: -e.modified)
    found += [paths.resolve(spark, e.path) for e in exports]
    return list(dict.fromkeys(found))


def _csv(spark: SparkSession, files: list[str], columns: list[str]) -> DataFrame:
    """Rows of CSV files that begin with the same header; a name that repeats counts once."""
    names = [c if c not in columns[:i] else f"_again_{i}" for i, c in enumerate(columns)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    # Names that differ in case only are different columns.
    return reader.schema(schema).csv(files)


def _file_uri(c: Column) -> Column:
    """A file's path as Hadoop prints it (scheme with one slash, nothing encoded)."""
    plain = F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([a-zA-Z0-9]+):///", "$1:/")


def _placed(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Parts with the listed path that they are or lie in, and its place in the list."""
    known = lookup_side(files)
    folder = F.regexp_replace("_part", "/[^/]*$", "")
    whole = parts.join(known.select(F.col("_path").alias("_part"), F.col("_path").alias("_own"), F.col("_file").alias("_n")), "_part", "left")
    inside = whole.withColumn("_path", F.coalesce("_own", folder)).join(known, "_path", "left")
    return inside.withColumn("_file", F.coalesce("_n", "_file")).drop("_own", "_n")


def header_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``_part, header``: the first line of every file, from one scan over the files' first blocks."""
    lines = spark.read.text(files).select(
        _file_uri(F.col("_metadata.file_path")).alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    first = lines.filter("_block = 0").groupBy("_part")
    line = F.rtrim(F.min_by("value", "_row"), F.lit("\r"))
    return first.agg(F.regexp_replace(line, "^\ufeff", "").alias("header"))


def labeled_frames(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """Training frames of the usable files, one per distinct header.

    All headers come from one scan, and files that share one are read in one scan, so the number
    of jobs follows the number of headers. A file is a CSV file or a folder of parts; files without
    the needed columns, empty ones among them, are left out. More than ``MAX_HEADERS`` different
    headers are an error.
    """
    if not files:
        return []
    listed = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "_path string, _file int")
    headers = header_lines(spark, files).groupBy("header").agg(F.collect_list("_part").alias("parts"))
    found = headers.limit(MAX_HEADERS + 1).collect()  # the paths come back to be read
    if len(found) > MAX_HEADERS:
        raise ValueError(f"labeled files have more than {MAX_HEADERS} different headers")
    frames = []
    for header, parts in sorted((r["header"], r["parts"]) for r in found):
        columns = next(csv.reader([header]), [])
        try:
            text, label, _ = label_columns(columns)
        except ValueError:
            continue
        rows = _csv(spark, sorted(parts), columns).select(
            *[
                F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c)
                for c in dict.fromkeys(columns)
                if c in (text, label, "sentiment_confidence", "sentiment_score")
            ],
            _file_uri(F.col("_metadata.file_path")).alias("_part"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
        frames.append(
            training_frame(_placed(rows, listed), F.col("_path"), ["_file", "_part", "_block", "_row"])
        )
    return frames


def training_corpus(spark: SparkSession, files: list[str]) -> DataFrame:
    """Merged corpus of all usable files; none usable, or one label only, is an error."""
    frames = labeled_frames(spark, files)
    if not frames:
        raise FileNotFoundError("no trainable CSV files were found")
    corpus = merge_frames(frames)
    require_two_labels(corpus)
    return corpus
