"""Scorers: functions from ``(texts, keys)`` to label, score, confidence, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.functions import text as t
from posttide.ml import classifier as cl
from posttide.operators import lexicon as lex
from posttide.session import cut_lineage
from posttide.sinks import paths
from posttide.sources.labeled import training_corpus

Scorer = Callable[[DataFrame, list[str]], DataFrame]

_EMPTY = '{"reason":"empty_cleaned_text"}'


def lexicon_scorer(lexicon: DataFrame, rules: lex.Rules | None = None) -> Scorer:
    def score(texts: DataFrame, keys: list[str]) -> DataFrame:
        scored = lex.score_texts(texts, lexicon, keys, rules=rules)
        return scored.select(
            *keys, "label", "score", "confidence", lex.lexicon_metadata().alias("metadata")
        )

    return score


def ml_scorer(model: cl.SentimentClassifier) -> Scorer:
    def score(texts: DataFrame, keys: list[str]) -> DataFrame:
        scored = model.predict(texts, keys)
        return scored.select(
            *keys, "label", "score", "confidence", model.prediction_metadata().alias("metadata")
        )

    return score


def load_or_train(
    spark: SparkSession, model_path: str, training_path: str, auto_train: bool = True
) -> cl.SentimentClassifier:
    """Saved model if there is one; else train on the configured file alone and save."""
    if paths.exists(spark, f"{model_path}/terms"):
        return cl.SentimentClassifier.load(spark, model_path)
    if not auto_train:
        raise FileNotFoundError(f"no model at {model_path} and automatic training is off")
    if not paths.exists(spark, training_path):
        raise FileNotFoundError(f"no training data at {training_path}")
    corpus = training_corpus(spark, [paths.resolve(spark, training_path)])
    cl.train_from_frame(cut_lineage(corpus)).save(model_path)
    return cl.SentimentClassifier.load(spark, model_path)


def resolve_scorer(
    spark: SparkSession,
    name: str,
    lexicon: DataFrame | None = None,
    model_path: str | None = None,
    training_path: str | None = None,
    auto_train: bool = True,
) -> Scorer:
    """``vader`` with the lexicon given, ``sample_lexicon`` with the small one that comes along, or
    ``ml``; any other name is an error."""
    kind = name.lower()
    if kind == "vader":
        if lexicon is None:
            raise ValueError("the scorer `vader` needs its lexicon; `sample_lexicon` has a small one")
        return lexicon_scorer(lexicon)
    if kind == "sample_lexicon":
        return lexicon_scorer(lex.seed_lexicon(spark))
    if kind == "ml":
        return ml_scorer(load_or_train(spark, model_path, training_path, auto_train))
    raise ValueError(f"unsupported sentiment model: {name}")


def analyze(posts: DataFrame, scorer: Scorer, key: str = "ordinal") -> DataFrame:
    """Posts with cleaned text, tokens and sentiment. ``key`` identifies a row.

    The scorer sees cleaned text only; empty text is neutral with full confidence.
    """
    cleaned = posts.withColumn("cleaned_text", t.clean_text(F.col("content")))
    scored = scorer(cleaned.select(key, "cleaned_text"), [key]).select(
        key,
        F.col("label").alias("_label"),
        F.col("score").alias("_score"),
        F.col("confidence").alias("_confidence"),
        F.col("metadata").alias("_metadata"),
    )
    empty = F.col("cleaned_text") == ""
    return (
        cleaned.join(scored.hint("shuffle_hash"), key)  # scores are short, so posts need no sort
        .withColumns(
            {
                "tokens": t.tokenize(F.col("cleaned_text")),
                "sentiment_label": F.when(empty, F.lit("neutral")).otherwise(F.col("_label")),
                "sentiment_score": F.when(empty, F.lit(0.0)).otherwise(F.col("_score")),
                "sentiment_confidence": F.when(empty, F.lit(1.0)).otherwise(
                    F.col("_confidence")
                ),
                "sentiment_metadata": F.when(empty, F.lit(_EMPTY)).otherwise(F.col("_metadata")),
            }
        )
        .drop("_label", "_score", "_confidence", "_metadata")
    )
