"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.llm.common import WORD, stored
from posttide.session import lookup_side

# Buckets that words and word pairs are hashed to; the model is one number for each.
BUCKETS = 1 << 14
# Trusted rows that are used, at most; those with the least hash of doc_id. Half of them fit the
# target multinomial, the others set the threshold: texts the model has seen score too well.
TRUSTED_ROWS = 20_000
# Share of the trusted rows that the threshold turns away at most, and the standard deviations
# below their mean score that it lies at least.
TURNED_AWAY, DEVIATIONS = 0.005, 3.0
# Words of a window, and the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _buckets(hashes: Column) -> Column:
    """Buckets of the words, then of the pairs of neighbours."""
    pair = F.transform(
        hashes,
        lambda h, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(hashes, i - 1), h), F.lit(BUCKETS))),
    )
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS))), F.array_compact(pair)
    )


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows of 5 words that the text holds twice or more.

    Most texts repeat no window, which counting the distinct ones shows. Otherwise the windows are
    sorted with their places; those equal to a neighbour cover up to 5 words each, fewer where the
    next one starts earlier.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(
                places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1), p + WINDOW) - p)
            ),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def places(pairs: Column) -> Column:
        again = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"]))
            | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(again, lambda p: p["i"]))

    def count(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")
        ).otherwise(_let(_let(pairs, places), covered))

    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(
        starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])
    )
    return _let(windows, count)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, and the word hashes the model reads."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("__text")).withColumn(
        "__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))
    )
    hashed = read.withColumn("__hashes", _hashes(F.col("__words")))
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD))
    symbols = F.regexp_replace("__text", r"[^#*$%&|<>]+", "")
    n_words = F.size("__words").cast("long")
    repeated = _repeated_words(F.col("__hashes"))
    return hashed.select(
        "doc_id",
        n_words.alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(symbols).cast("long").alias("n_symbols"),
        _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long")
        .alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        "__hashes",
    )


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted rows that the model is fitted on, ``rows`` at most, and of all others."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    order = F.xxhash64(F.lit("trusted"), F.col("doc_id"))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)) == 0
    fit = ids.filter(half).orderBy(order, "doc_id").limit(rows)
    return fit, ids.join(F.broadcast(fit), "doc_id", "left_anti")


def _weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log p(bucket | trusted) - log p(bucket | raw).

    The raw counts are smoothed by one, the trusted ones by as many pseudo-counts, shared out like
    the raw corpus: with few trusted texts the ratios shrink towards none.
    """
    fit = F.broadcast(trusted.withColumn("__trusted", F.lit(1)))  # TRUSTED_ROWS at most
    flagged = docs.select("doc_id", "text").join(fit, "doc_id", "left")
    hashes = _hashes(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    counts = (
        flagged.select("__trusted", hashes.alias("__hashes"))
        .select("__trusted", F.explode(_buckets(F.col("__hashes"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("trusted"))
        .collect()  # at most BUCKETS rows
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["trusted"]
    if not sum(target):
        return [0.0] * BUCKETS
    n_target, n_raw = sum(target) + BUCKETS, sum(raw) + BUCKETS
    shares = [(r + 1) / n_raw for r in raw]
    return [math.log((t + BUCKETS * p) / (n_target * p)) for t, p in zip(target, shares, strict=True)]


def _score(hashes: Column, weights: list[float]) -> Column:
    model = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return _let(
        _buckets(hashes),
        lambda found: F.aggregate(
            found, F.lit(0.0), lambda a, b: a + F.get(model, b.cast("int"))
        )
        / F.size(found),
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base measures of every document, and whether it is kept.

    The model is the log ratio, per hash bucket of words and word pairs, between the texts labelled
    as trusted and all texts; a text's score is its mean. The threshold comes from all
    trusted rows that the model was not fitted on: ``TURNED_AWAY`` of them score less, and it lies
    ``DEVIATIONS`` below their mean at least, which counts where they are few. Null text has no words and fails the base rules, as
    has every text of fewer than 10 words. Repeated rows are judged alike; null ids are never
    trusted. Without trusted rows only the base rules hold. Empty tables give an empty result.
    """
    fit, other = trusted_ids(labels)
    weights = _weights(docs, fit)
    score = F.when(F.col("n_words") > 0, _score(F.col("__hashes"), weights))
    # Texts are scored once and stay where they are: only ids and scores meet the trusted rows.
    rows = stored(measured(docs).withColumn("score", score).drop("__hashes"), "measured")
    unseen = rows.select("doc_id", "score").join(lookup_side(other), "doc_id", "left_semi")
    # Rounded, so that the quantile counts a bounded number of different scores.
    scores = unseen.select(F.round("score", 6).alias("s"))
    level = scores.agg(
        F.percentile("s", F.lit(TURNED_AWAY)).alias("low"),
        (F.avg("s") - DEVIATIONS * F.coalesce(F.stddev_samp("s"), F.lit(0.0))).alias("far"),
    ).first()
    threshold = None if level["low"] is None else min(level["low"], level["far"])
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    good = F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold)
    scored = [c for c in rows.columns if c != "score"]
    return rows.select(*scored, failed.alias("base_failed"), "score").withColumn("kept", ~F.col("base_failed") & good)
