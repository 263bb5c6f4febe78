"""Labeled rows to one weighted training corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.functions.labels import LABELS, MANUAL_WEIGHT, canonical_label, sample_weight
from posttide.functions.text import strip_ws, text_key

MANUAL = "manual_labels"
PROCESSED = "processed_export"

# Weights are added as decimals: the sum, and so the winning label, does not
# depend on how rows are split over tasks.
_WEIGHT = "decimal(24,12)"


def label_columns(columns: list[str]) -> tuple[str, str, str]:
    """Text column, label column and kind of a labeled table, from its column names."""
    for text, label, kind in (
        ("text", "label", MANUAL),
        ("cleaned_text", "sentiment_label", PROCESSED),
        ("content", "sentiment_label", PROCESSED),
    ):
        if text in columns and label in columns:
            return text, label, kind
    raise ValueError(
        "labeled data needs text/label, cleaned_text/sentiment_label or content/sentiment_label"
    )


def training_frame(rows: DataFrame, source_path: Column, order: list[str]) -> DataFrame:
    """Usable labeled rows with their weight; ``order`` columns ride along as ``_order``."""
    text, label, kind = label_columns(rows.columns)

    def optional(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    prepared = rows.select(
        strip_ws(F.col(text).cast("string")).alias("text"),
        canonical_label(F.col(label).cast("string")).alias("label"),
        optional("sentiment_confidence").alias("_confidence"),
        optional("sentiment_score").alias("_score"),
        source_path.alias("source_path"),
        F.struct(*order).alias("_order"),
    ).filter("text IS NOT NULL AND text <> '' AND label IS NOT NULL")
    if kind == MANUAL:
        weight = F.lit(MANUAL_WEIGHT)
    else:
        weight = sample_weight(F.col("label"), F.col("_confidence"), F.col("_score"))
    return prepared.select(
        "text", "label", weight.alias("sample_weight"), "source_path",
        F.lit(kind).alias("source_kind"), "_order",
    )


def union_frames(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("at least one training frame is required")
    return reduce(DataFrame.unionByName, frames)


def merge_frames(frames: list[DataFrame]) -> DataFrame:
    """One row per distinct text: its weighted majority label, total weight and support.

    The three labels are known, so one aggregate on the text key gathers all
    votes; copies of a text are summed per task before the shuffle. Equal weights
    go to the larger support, then to the label first in the alphabet. The text
    shown is the first of the longest spellings.
    """
    # The key is blank exactly when the text is.
    worded = union_frames(frames).filter(strip_ws(F.col("text")) != "")
    keyed = worded.withColumn("_key", text_key(F.col("text")))

    def votes(label: str) -> list[Column]:
        mine = F.col("label") == label
        return [
            F.sum(F.when(mine, F.col("sample_weight").cast(_WEIGHT))).alias(f"_w_{label}"),
            F.count_if(mine).alias(f"_n_{label}"),
            F.collect_set(F.when(mine, F.col("source_path"))).alias(f"_p_{label}"),
            F.collect_set(F.when(mine, F.col("source_kind"))).alias(f"_k_{label}"),
        ]

    # Smallest struct = longest text, then earliest row.
    shown = F.min_by("text", F.struct((-F.length("text")).alias("length"), F.col("_order")))
    merged = keyed.groupBy("_key").agg(
        shown.alias("text"), *[c for label in LABELS for c in votes(label)]
    )
    candidates = [
        F.when(
            F.col(f"_n_{label}") > 0,
            F.struct(
                (-F.col(f"_w_{label}")).alias("weight"),
                (-F.col(f"_n_{label}")).alias("support"),
                F.lit(label).alias("label"),
                F.col(f"_p_{label}").alias("paths"),
                F.col(f"_k_{label}").alias("kinds"),
            ),
        )
        for label in LABELS
    ]
    best = F.array_min(F.array_compact(F.array(*candidates)))
    return merged.select("text", best.alias("_best")).select(
        "text",
        F.col("_best.label").alias("label"),
        (-F.col("_best.weight")).cast("double").alias("sample_weight"),
        (-F.col("_best.support")).alias("support"),
        F.sort_array("_best.paths").alias("source_paths"),
        F.sort_array("_best.kinds").alias("source_kinds"),
    )


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def require_two_labels(rows: DataFrame, label: str = "label") -> None:
    """Raise unless two distinct labels occur."""
    if rows.select(label).distinct().limit(2).count() < 2:
        raise ValueError("at least two distinct labels are required for training")


def weight_summary(rows: DataFrame) -> DataFrame:
    weight = F.col("sample_weight")
    return rows.agg(
        F.min(weight).alias("min"), F.max(weight).alias("max"), F.avg(weight).alias("mean")
    )


def sources(corpus: DataFrame) -> DataFrame:
    """Where rows came from: ``what`` (source_path or source_kind), ``name``, ``rows``.

    One row for each name, counted in the tasks first; nothing is gathered over all files.
    """

    def names(column: str, what: str) -> Column:
        kind = corpus.schema[column].dataType.typeName()
        listed = F.col(column) if kind == "array" else F.array(column)
        return F.transform(listed, lambda name: F.struct(F.lit(what).alias("what"), name.alias("name")))

    empty = F.array().cast("array<struct<what:string,name:string>>")
    columns = (("source_paths", "source_path"), ("source_kinds", "source_kind"))
    listed = [
        F.coalesce(names(c, what), empty)
        for many, what in columns
        for c in (many, what)
        if c in corpus.columns
    ]
    named = corpus.select(F.inline(F.concat(empty, *listed)))
    return named.filter("name <> ''").groupBy("what", "name").agg(F.count(F.lit(1)).alias("rows"))


def provenance(corpus: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row: how many rows, their summed support, and how many sources of each kind.

    ``found`` is ``sources(corpus)``, when it is at hand as a table.
    """
    support = F.coalesce("support", F.lit(1)) if "support" in corpus.columns else F.lit(1)
    totals = corpus.agg(
        F.count(F.lit(1)).alias("deduplicated_examples"),
        F.coalesce(F.sum(support.cast("bigint")), F.lit(0)).alias("support_sum"),
    )
    counted = (sources(corpus) if found is None else found).agg(
        *[F.count_if(F.col("what") == what).alias(f"{what}s") for what in ("source_path", "source_kind")]
    )
    return totals.crossJoin(F.broadcast(counted))  # one row on each side
