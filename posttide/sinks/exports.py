"""CSV exports of raw and processed posts, and reading one back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.sinks import paths

PROCESSED_COLUMNS = (
    "tweet_id", "created_at", "username", "display_name", "content", "cleaned_text", "tokens",
    "sentiment_label", "sentiment_score", "sentiment_confidence", "sentiment_metadata",
)

# Columns that a raw export may have.
MAX_PAYLOAD_COLUMNS = 2_000


def export_name(source_query: Column, at: Column) -> Column:
    """File name of an export: slug of the search, then the UTC time."""
    slug = F.lower(F.btrim(F.regexp_replace(source_query, "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    short = F.coalesce(F.nullif(F.left(slug, F.lit(80)), F.lit("")), F.lit("tweets"))
    return F.concat(short, F.lit("_"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".csv"))


def export_path(spark: SparkSession, folder: str, source_query: str, at: datetime) -> str:
    row = spark.range(1).select(
        export_name(F.lit(source_query), F.lit(at).cast("timestamp")).alias("name")
    )
    return f"{folder.rstrip('/')}/{row.first()['name']}"


def _write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def processed_rows(analyzed: DataFrame) -> DataFrame:
    """The processed export's columns, nested ones as JSON, times as ISO text."""
    as_text = {
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "tokens": F.to_json("tokens"),
    }
    return analyzed.select(
        *[as_text.get(name, F.col(name)).alias(name) for name in PROCESSED_COLUMNS]
    )


def export_processed(analyzed: DataFrame, path: str) -> str | None:
    """Write the processed export; an empty batch writes nothing."""
    return None if analyzed.isEmpty() else _write_csv(processed_rows(analyzed), path)


def union_payloads(frames: list[DataFrame]) -> DataFrame:
    """Payload rows of different shapes under the union of their columns."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def payload_columns(payloads: DataFrame, most: int = MAX_PAYLOAD_COLUMNS) -> list[str]:
    """The top-level keys of ``payload`` maps, in order, from one aggregate over all rows.

    Each row becomes a variant that has its keys and no values; their common schema names every key
    once. More than ``most`` keys are an error: they would be columns of a table.
    """
    keys = F.transform_values("payload", lambda _, __: F.lit(True))
    found = payloads.agg(F.schema_of_variant_agg(F.to_variant_object(keys)).alias("shape")).first()["shape"]
    if not found or not found.startswith("OBJECT<"):
        return []
    names = T.DataType.fromDDL("STRUCT<" + found.removeprefix("OBJECT<")).names
    if len(names) > most:
        raise ValueError(f"payloads have {len(names)} different keys; a table has at most {most} columns")
    return sorted(names)


def payload_rows(posts: DataFrame) -> DataFrame:
    """Raw payloads as columns, the union of the top-level keys that occur."""
    keyed = posts.select(F.from_json("raw_payload", "map<string,string>").alias("payload"))
    names = payload_columns(keyed)
    return keyed.select(*[F.col("payload").getItem(name).alias(name) for name in names])


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_raw(posts: DataFrame, path: str) -> str | None:
    """Write the raw export; an empty batch writes nothing."""
    return None if posts.isEmpty() else _write_csv(flat_for_csv(payload_rows(posts)), path)


def read_export(spark: SparkSession, path: str | None, limit: int = 100) -> DataFrame:
    """First rows of an export; a missing one gives an empty frame."""
    if not path or not paths.exists(spark, path):
        return spark.createDataFrame([], T.StructType([]))
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return rows.csv(path).limit(limit)
