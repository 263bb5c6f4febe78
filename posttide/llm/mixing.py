"""Mixing sources to target weights: hash-random order, prefix sums, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posttide.llm.common import WORD, running_sums, slices, stored

# Sources in the order of their names take these weights in turn.
WEIGHTS = (5, 2, 1)
# Words of the mix, as a share of all words.
SHARE = 1.5
# Passes over a source that the mix may take at most.
MOST = 2.0


def size_column(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, source_rows) -> the same with ``target``.

    The budget is shared by weight; a source stops at ``most`` times its size, and what it leaves
    is shared again by weight among the others until none is above. Each round fixes the sources
    that would be above, and takes one aggregate over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    listed = stored(
        sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn(
            "__cap", F.col("source_size") * F.lit(most)
        ),
        "targets",
    )
    rate = 0.0
    while True:
        # Sources whose cap is below the present rate are fixed; the rest is shared anew.
        fixed = F.col("__cap") <= F.col("__w") * F.lit(rate)
        now = listed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(fixed, F.col("__cap"))).alias("fixed"),
            F.sum(F.when(~fixed, F.col("__w"))).alias("open"),
        ).first()
        if not now["open"]:
            break
        left = (share * now["all"] - (now["fixed"] or 0.0)) / now["open"]
        if left <= rate:
            break
        rate = left
    target = F.least(F.col("__cap"), F.col("__w") * F.lit(rate)).cast("double")
    return listed.withColumn("target", target).drop("__w", "__cap")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs doc_id, source and text; ``carry`` names columns that go along. Returns doc_id,
    source, size, source_size, target, taken and, under ``__row``, the carried columns.

    Documents of a source are put into the order of a hash of doc_id. The whole words of the
    target are cut from that order, repeated as often as needed: every document is taken as often
    as the budget holds the whole source, and the last pass ends at the exact word, inside a
    document if need be. Null text has size 0; null sources are one source, last in order; null
    ids hash like any other value; rows that repeat an id are rows of their own, ordered by size,
    so that reruns agree. An empty table gives an empty result.
    """
    rows = docs.select(
        "doc_id",
        "source",
        size_column().alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), size_column()).alias("__key"),
        *([F.struct(*carry).alias("__row")] if carry else []),
    )
    if not carry:  # narrow rows are written; texts are read twice instead
        rows = stored(rows, "sizes")
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    targets = stored(source_targets(sizes), "targets")
    n = slices(targets.agg(F.sum("source_rows")).first()[0] or 0)
    placed = running_sums(rows, ["source"], "__key", ["doc_id", "size"], {"before": F.col("size")}, n)
    targets = targets.withColumnRenamed("source", "__source")
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["__source"]))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        *(["__row"] if carry else []),
    )


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: a row for each time a document is taken, the last one cut at its word.

    Returns the columns of ``docs``; a cut text ends after the last word taken.
    """
    columns = docs.columns
    mixed = mix(docs, tuple(columns), seed)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    cut = F.col("taken") - whole * F.col("size")
    takes = F.flatten(
        F.array(
            F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
            F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")),
        )
    )
    rows = mixed.select("__row.*", F.explode(takes).alias("__words"))
    # The shortest prefix that holds so many words; a repetition count is bounded in regular
    # expressions, so the words are counted on the split text.
    lead = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    pieces = F.split(F.substring(F.col("text"), F.length(lead) + 1, F.length("text")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    shortened = F.concat(lead, F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("__words"), F.lit(1)).cast("int")), ""))
    text = F.when(F.col("__words") < 0, F.col("text")).otherwise(
        F.regexp_replace(shortened, r"[\x20\x09-\x0D]+$", "")
    )
    return rows.withColumn("text", text).select(*columns)
