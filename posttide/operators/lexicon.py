"""Lexicon sentiment as a relational job: words, joined valences, one sum per text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.functions import lexicon_words as words
from posttide.functions.labels import by_label, clip, compound_label, round_half_up
from posttide.functions.text import whitespace_tokens
from posttide.session import lookup_side

# Fixed values of the published method.
NEGATE = -0.74
NEVER_SO = 1.25
ALPHA = 15.0
BEFORE_CONTRAST = 0.5
AFTER_CONTRAST = 1.5
BOOST_BY_DISTANCE = (1.0, 0.95, 0.9)


@dataclass(frozen=True)
class Rules:
    """Word lists the scorer uses next to the lexicon table; all are short settings."""

    boosters: dict[str, float] = field(default_factory=lambda: dict(words.BOOSTERS))
    booster_pairs: dict[str, float] = field(default_factory=lambda: dict(words.BOOSTER_PAIRS))
    negations: tuple[str, ...] = words.NEGATIONS
    idioms: dict[str, float] = field(default_factory=lambda: dict(words.IDIOMS))
    contrast: str = "but"


def seed_lexicon(spark: SparkSession) -> DataFrame:
    """The shipped sample lexicon: ``token, valence``."""
    rows = sorted(words.SEED_LEXICON.items())
    return spark.createDataFrame(rows, "token string, valence double")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated lexicon file (token, mean valence, ...); one row per token."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return (
        rows.select(
            F.lower("_c0").alias("token"), F.col("_c1").try_cast("double").alias("valence")
        )
        .filter("token IS NOT NULL AND valence IS NOT NULL")
        .groupBy("token")
        .agg(F.max("valence").alias("valence"))
    )


def _pick(c: Column, values: dict[str, float], default: Column) -> Column:
    """Value listed for ``c``, else ``default``."""
    by_value: dict[float, list[str]] = {}
    for word, value in values.items():
        by_value.setdefault(value, []).append(word)
    picked = default
    for value, listed in by_value.items():
        picked = F.when(c.isin(*listed), F.lit(value)).otherwise(picked)
    return picked


def _word_rows(texts: DataFrame, keys: list[str], text: str, rules: Rules) -> DataFrame:
    """One row per word with its neighbours and the word count of its text.

    The neighbours come from shifted copies of the word array, so a row carries
    six words and not the array; the work stays linear in the text.
    """
    split = texts.select(*keys, whitespace_tokens(F.col(text)).alias("_words"))
    none = F.array(*[F.lit(None).cast("string")] * 3)
    n = F.size("_words")

    def shifted(offset: int) -> Column:
        return F.slice("_padded", F.lit(4 + offset), n)

    zipped = F.arrays_zip(
        F.col("_words").alias("token"),
        *[shifted(-k).alias(f"p{k}") for k in (1, 2, 3)],
        *[shifted(k).alias(f"n{k}") for k in (1, 2)],
    )
    split = split.withColumn("_padded", F.concat(none, "_words", none))
    # Both arrays are used up below the generator: only keys and words leave it.
    ready = split.select(
        *keys,
        n.alias("_n"),
        F.array_position("_words", F.lit(rules.contrast)).cast("int").alias("_contrast"),
        zipped.alias("_zipped"),
    )
    words = ready.select(
        *keys, "_n", "_contrast", F.posexplode_outer("_zipped").alias("_pos", "_word")
    )
    return words.select(*keys, "_n", "_contrast", "_pos", "_word.*")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _intensifier(c: Column) -> Column:
    return _yes(c.isin("so", "this"))


def _lexicon_words(rows: DataFrame, lexicon: DataFrame, rules: Rules) -> DataFrame:
    """Rows of lexicon words with their ``valence``, and the first row of every text.

    The first row keeps texts without lexicon words; all others end here.
    """
    modifier = F.col("token").isin(*rules.boosters) | (
        (F.col("token") == "kind") & _yes(F.col("n1") == "of")
    )
    valued = rows.join(lexicon, "token", "left").withColumn(
        "valence", F.when(~modifier, F.col("valence"))
    )
    return valued.filter(
        F.col("valence").isNotNull() | F.coalesce(F.col("_pos") == 0, F.lit(True))
    )


def _listed(rows: DataFrame, lexicon: DataFrame, name: str, needed: Column) -> DataFrame:
    """Add ``in_<name>``: the neighbour is a lexicon word. Looked up only where needed;
    elsewhere the join key is null, which never matches."""
    words = lexicon.select(F.col("token").alias("_key"), F.lit(True).alias(f"in_{name}"))
    probe = F.when(F.col("valence").isNotNull() & needed, F.col(name))
    return rows.join(words, probe == F.col("_key"), "left").drop("_key")


def _phrases(*groups: tuple[str, ...]) -> Column:
    """Array of the phrases made of neighbouring words; null where one is missing."""
    return F.array(
        *[
            F.concat(*[part for name in names for part in (F.lit(" "), F.col(name))][1:])
            for names in groups
        ]
    )


def _word_score(rows: DataFrame, lexicon: DataFrame, rules: Rules) -> DataFrame:
    """``_score`` of every kept word after boosters, negations and idioms."""
    p1, p2, p3, token = (F.col(c) for c in ("p1", "p2", "p3", "token"))
    v = F.col("_v")

    # Modifiers that are lexicon words themselves do not modify. Only the modifier
    # lists, which are short settings, are looked up here.
    modifiers = [*rules.boosters, *rules.negations, "least"]
    valued = {
        row["token"]
        for row in lexicon.filter(F.col("token").isin(*modifiers)).select("token").collect()
    }
    boosters = {w: b for w, b in rules.boosters.items() if w not in valued}
    negations = [w for w in rules.negations if w not in valued]

    phrase_words = {w for phrase in rules.idioms for w in phrase.split()}
    phrase_words |= {w for phrase in rules.booster_pairs for w in phrase.split()}
    in_phrase = F.lit(False)
    if phrase_words:
        in_phrase = _yes(token.isin(*phrase_words)) | _yes(p2.isin(*phrase_words))
    rows = _listed(rows, lexicon, "p3", _intensifier(p1) | in_phrase)
    rows = _listed(rows, lexicon, "n1", token == "no")

    def negated(c: Column) -> Column:
        return _yes(c.isin(*negations))

    one, never, negate = F.lit(1.0), F.lit(NEVER_SO), F.lit(NEGATE)
    p3_free = p3.isNotNull() & F.col("in_p3").isNull()
    factors = (
        F.when(negated(p1), negate).otherwise(one),
        F.when(negated(p2) & (p2 == "never") & _intensifier(p1), never)
        .when(negated(p2) & (p2 == "without") & _yes(p1 == "doubt"), one)
        .when(negated(p2), negate)
        .otherwise(one),
        F.when(
            p3_free & ((_yes(p3 == "never") & _intensifier(p2)) | _intensifier(p1)), never
        )
        .when(negated(p3) & (p3 == "without") & _yes(p2.eqNullSafe("doubt") | (p1 == "doubt")), one)
        .when(negated(p3), negate)
        .otherwise(one),
    )
    after_no = _yes(p1 == "no") | _yes(p2 == "no") | (_yes(p3 == "no") & _yes(p1.isin("or", "nor")))
    rows = rows.withColumn(
        "_v",
        F.when(after_no, F.col("valence") * negate)
        .when((token == "no") & F.col("in_n1").isNotNull(), F.lit(0.0))
        .otherwise(F.col("valence")),
    )
    # Each step is a projection of its own, so that an earlier value is computed once.
    for before, factor, damping in zip((p1, p2, p3), factors, BOOST_BY_DISTANCE):
        boost = _pick(before, boosters, F.lit(0.0)) * F.lit(damping)
        rows = rows.withColumn("_v", (v + F.when(v < 0, -boost).otherwise(boost)) * factor)
    if phrase_words:
        rows = rows.withColumn("_v", F.when(p3_free & in_phrase, _idiom(rules)).otherwise(v))
    least = _yes(p1 == "least") & ~_yes(p2.isin("at", "very"))
    if "least" in valued:
        least = F.lit(False)
    return rows.withColumn("_score", v * F.when(least, negate).otherwise(one))


def _idiom(rules: Rules) -> Column:
    """``_v`` replaced by an idiom the word is part of, plus two-word boosters.

    Idioms that look ahead win over those that end with the word.
    """
    idioms = F.create_map(*[F.lit(x) for kv in rules.idioms.items() for x in kv])
    pairs = F.create_map(*[F.lit(x) for kv in rules.booster_pairs.items() for x in kv])

    def found(table: Column, *groups: tuple[str, ...]) -> Column:
        values = F.transform(
            F.array_compact(_phrases(*groups)), lambda phrase: F.try_element_at(table, phrase)
        )
        return F.array_compact(values)

    value = F.col("_v")
    if rules.idioms:
        hits = found(
            idioms,
            ("token", "n1", "n2"), ("token", "n1"),
            ("p1", "token"), ("p2", "p1", "token"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"),
        )
        value = F.coalesce(F.get(hits, F.lit(0)), value)
    if rules.booster_pairs:
        extra = found(pairs, ("p3", "p2", "p1"), ("p3", "p2"), ("p2", "p1"))
        value = value + F.aggregate(extra, F.lit(0.0), lambda total, x: total + x)
    return value


def score_texts(
    texts: DataFrame,
    lexicon: DataFrame,
    keys: list[str],
    text: str = "cleaned_text",
    rules: Rules | None = None,
) -> DataFrame:
    """Label, score, confidence and shares of every text: one row per ``keys``.

    ``keys`` must identify a row. All words of a text sit in one task, so the
    partial aggregate leaves one short row per text for the shuffle.
    """
    rules = rules or Rules()
    lexicon = lookup_side(lexicon.select("token", "valence"))
    words = _lexicon_words(_word_rows(texts, keys, text, rules), lexicon, rules)
    place = F.col("_pos") + 1
    contrast = (
        F.when(F.col("_contrast") == 0, F.lit(1.0))
        .when(place < F.col("_contrast"), F.lit(BEFORE_CONTRAST))
        .when(place > F.col("_contrast"), F.lit(AFTER_CONTRAST))
        .otherwise(F.lit(1.0))
    )
    scored = _word_score(words, lexicon, rules).select(
        *keys, "_n", (F.col("_score") * contrast).alias("_s")
    )
    s = F.col("_s")
    sums = scored.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        F.coalesce(F.sum(s), F.lit(0.0)).alias("_sum"),
        F.sum(F.when(s > 0, s + 1.0).otherwise(0.0)).alias("_pos_sum"),
        F.sum(F.when(s < 0, 1.0 - s).otherwise(0.0)).alias("_neg_sum"),
        (F.max("_n") - F.count_if(s != 0)).alias("_neu_sum"),
    )
    return _shares(sums, keys)


def _shares(sums: DataFrame, keys: list[str]) -> DataFrame:
    raw = F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + F.lit(ALPHA))
    total = F.col("_pos_sum") + F.col("_neg_sum") + F.col("_neu_sum")

    def share(name: str) -> Column:
        return round_half_up(F.try_divide(F.col(name).cast("double"), total), 3)

    # An array that is null or empty has size 0 or less.
    empty = F.col("_n") <= 0
    zero, one = F.lit(0.0), F.lit(1.0)
    scored = sums.select(
        *keys,
        F.when(empty, zero).otherwise(round_half_up(clip(raw, -1.0, 1.0), 4)).alias("score"),
        F.when(empty, zero).otherwise(share("_neg_sum")).alias("neg"),
        F.when(empty, one).otherwise(share("_neu_sum")).alias("neu"),
        F.when(empty, zero).otherwise(share("_pos_sum")).alias("pos"),
    )
    label = compound_label(F.col("score"))
    return scored.withColumn("label", label).withColumn(
        "confidence", by_label(F.col("label"), F.col("pos"), F.col("neg"), F.col("neu"))
    ).select(*keys, "label", "score", "confidence", "neg", "neu", "pos")


def lexicon_metadata() -> Column:
    """Score details as JSON."""
    shares = F.struct("neg", "neu", "pos", F.col("score").alias("compound"))
    return F.to_json(F.struct(F.col("score").alias("compound"), shares.alias("scores")))
