"""TF-IDF terms as relations: counts per text, document frequencies, weights.

Texts are shuffled once, by their key, before they are exploded. All later
groupings by key then run inside the tasks, and exploded terms cross the network
only as per-task counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.functions.text import NOT_WS, WORD, strip_accents
from posttide.session import BROADCAST_MAX_ROWS

WORD_BLOCK = "word"
CHAR_BLOCK = "char"
CHAR_SIZES = (3, 4, 5)
MAX_DF = 0.95

# A term found in more than one in so many of all rows is heavy.
HEAVY = 100_000


def word_terms(text: Column) -> Column:
    """Words of two or more letters, lower-cased and without accents, and their pairs."""
    return _words(strip_accents(F.lower(text)))


def _words(plain: Column) -> Column:
    words = F.regexp_extract_all(plain, F.lit(f"{WORD}{{2,}}"), F.lit(0))
    return F.coalesce(words, F.array().cast("array<string>"))


def with_pairs(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), rest),
        F.slice(words, F.lit(2), rest),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def char_words(text: Column) -> Column:
    """Space-separated pieces of the lower-cased text."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"{NOT_WS}+"), F.lit(0))
    return F.coalesce(pieces, F.array().cast("array<string>"))


def with_grams(words: DataFrame, word: str, name: str) -> DataFrame:
    """One row per 3- to 5-gram of ``word``, padded with one space on each side.

    Two generators over plain expressions: start positions, then the sizes that fit.
    """
    rest = [c for c in words.columns if c != word]
    smallest = min(CHAR_SIZES)
    padded = words.select(
        *rest,
        F.concat(F.lit(" "), word, F.lit(" ")).alias("_padded"),
        (F.length(word) + 2).alias("_length"),
    )
    placed = padded.select(
        *rest,
        "_padded",
        "_length",
        F.explode(F.sequence(F.lit(1), F.col("_length") - (smallest - 1))).alias("_at"),
    )
    sizes = [
        F.when(F.col("_at") + (n - 1) <= F.col("_length"), F.substring("_padded", F.col("_at"), F.lit(n)))
        for n in CHAR_SIZES
    ]
    grams = placed.select(*rest, F.explode(F.array(*sizes)).alias(name))
    return grams.filter(F.col(name).isNotNull())


def _by_text(texts: DataFrame, key: str) -> DataFrame:
    """Spread texts by key over all shuffle partitions. The number is given, because
    the exploded rows are many times larger than the texts an estimate would see."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def term_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, block, term, tf`` of both blocks, plus one row with a null term per text.

    The first of ``keys`` identifies a text; others ride along. The null row keeps
    texts without terms. Character grams are counted per distinct word of a text
    first, so repeated words cost once. Accents go before the texts move: a step in
    Python after it would hide from Spark that a text's terms are in one task.
    """
    plain = strip_accents(F.lower(text)).alias("_plain")
    placed = _by_text(texts.select(*keys, text, plain), keys[0])
    marker = F.array(F.lit(None).cast("string"))
    words = placed.select(*keys, _words(F.col("_plain")).alias("_words"))
    terms = words.select(
        *keys, F.explode(F.concat(with_pairs(F.col("_words")), marker)).alias("term")
    )
    by_word = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    pieces = placed.select(*keys, F.explode(char_words(F.col(text))).alias("_word"))
    counted = pieces.groupBy(*keys, "_word").agg(F.count(F.lit(1)).alias("_n"))
    by_gram = with_grams(counted, "_word", "term").groupBy(*keys, "term").agg(F.sum("_n").alias("tf"))

    def block(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.lit(name).alias("block"), "term", "tf")

    return block(by_word, WORD_BLOCK).unionByName(block(by_gram, CHAR_BLOCK))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``block, term, df``; a count row is one text, so rows are just counted."""
    return (
        counts.filter(F.col("term").isNotNull())
        .groupBy("block", "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def kept_term(block: Column, df: Column, n_texts: Column | int) -> Column:
    """Words found in more than 95 % of the texts are left out; grams never are."""
    n = n_texts if isinstance(n_texts, Column) else F.lit(n_texts)
    return (df > 0) & ((block != WORD_BLOCK) | (df <= n * F.lit(MAX_DF)))


def idf(df: Column, n_texts: Column | int) -> Column:
    """Smoothed inverse document frequency, plus one."""
    n = n_texts if isinstance(n_texts, Column) else F.lit(n_texts)
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def damped(tf: Column) -> Column:
    return F.log(tf.cast("double")) + 1.0


def raw_weight() -> Column:
    """Damped term frequency times ``idf``, before the text's length is divided out."""
    return damped(F.col("tf")) * F.col("idf")


def with_terms(counts: DataFrame, known: DataFrame, n_terms: int, n_rows: int) -> DataFrame:
    """Rows of ``counts`` with what is ``known`` of their term (block, term, df, ..); inner join.

    A vocabulary small enough goes to every task whole. Of a larger one only the heavy terms do:
    those with more than one in ``HEAVY`` of all rows, so fewer than ``HEAVY`` terms. The rest is
    joined by shuffle, where no term has more than that share of the rows. Rows without a term
    never travel.
    """
    rows = counts.filter(F.col("term").isNotNull())
    if n_terms <= BROADCAST_MAX_ROWS:
        return rows.join(F.broadcast(known), ["block", "term"])
    heavy = known.filter(F.col("df") > n_rows / HEAVY).withColumn("_heavy", F.lit(True))
    marked = rows.join(F.broadcast(heavy), ["block", "term"], "left")
    by_map = marked.filter("_heavy").drop("_heavy")
    light = marked.filter("_heavy IS NULL").select(*rows.columns)
    return by_map.unionByName(light.join(known.filter(F.col("df") <= n_rows / HEAVY), ["block", "term"]))


def idf_table(counts: DataFrame, n_texts: int) -> DataFrame:
    """``block, term, df, idf`` of the kept terms."""
    frequencies = document_frequency(counts)
    kept = frequencies.filter(kept_term(F.col("block"), F.col("df"), n_texts))
    return kept.withColumn("idf", idf(F.col("df"), n_texts))
