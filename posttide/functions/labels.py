"""Label, weight and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posttide.functions.text import strip_ws

# Accepted spellings of the three labels.
LABEL_ALIASES = {
    "positive": "positive",
    "pos": "positive",
    "negative": "negative",
    "neg": "negative",
    "neutral": "neutral",
    "neu": "neutral",
}
LABELS = ("negative", "neutral", "positive")

MANUAL_WEIGHT = 3.0
POSITIVE_FROM = 0.05
NEGATIVE_FROM = -0.05


def canonical_label(c: Column) -> Column:
    """Canonical label, or null for an unknown spelling."""
    text = F.lower(strip_ws(c))
    label = F.lit(None).cast("string")
    for canonical in LABELS:
        spellings = [s for s, target in LABEL_ALIASES.items() if target == canonical]
        label = F.when(text.isin(*spellings), F.lit(canonical)).otherwise(label)
    return label


def number_or(c: Column, default: float) -> Column:
    """``c`` read as a number; null, NaN and unreadable text give ``default``."""
    number = c.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sample_weight(label: Column, confidence: Column, score: Column) -> Column:
    """Weight of a machine-labeled row, from its confidence and score strength."""
    sure = F.lit(0.4) + F.lit(0.9) * clip(number_or(confidence, 0.5), 0.0, 1.0)
    strength = clip(F.abs(number_or(score, 0.0)), 0.0, 1.0)
    by_label = F.when(label == "neutral", F.lit(0.85)).otherwise(F.lit(1.1))
    return clip(sure * by_label * (F.lit(0.75) + F.lit(0.5) * strength), 0.25, 3.0)


def compound_label(compound: Column) -> Column:
    """Label of a lexicon score; both bounds are inclusive."""
    return (
        F.when(compound >= POSITIVE_FROM, F.lit("positive"))
        .when(compound <= NEGATIVE_FROM, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def by_label(label: Column, positive: Column, negative: Column, neutral: Column) -> Column:
    return (
        F.when(label == "positive", positive)
        .when(label == "negative", negative)
        .otherwise(neutral)
    )


def safe_float(c: Column) -> Column:
    """Null and NaN become 0.0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def not_nan(c: Column) -> Column:
    """NaN becomes null, so that averages skip it."""
    return F.nanvl(c, F.lit(None).cast("double"))


def round_half_up(c: Column, digits: int) -> Column:
    """Round half away from zero in double arithmetic."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5).cast("double") / scale


def engagement(likes: Column, reposts: Column) -> Column:
    return likes + reposts
