"""Toxic passages: maximal scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide.llm.common import releasing, small_batches, stored

# Labelled rows the model is fitted on, at most; those with the least hash of doc_id.
MODEL_ROWS = 50_000
# Terms the model holds, at most; those with the largest z.
MODEL_TERMS = 50_000
# The Dirichlet prior: pseudo-counts shared out by the terms' frequency in all labelled texts, and
# what every term has besides.
PRIOR, LEAST = 100.0, 0.5
# Least z of a term that is told apart from its prior, and what a token costs a segment.
LEAST_Z, TOKEN_COST = 3.0, 0.5
# Letters that a stem keeps; it stands in for words that the model does not hold.
STEM = 4
THRESHOLD = 0.3
# Expected number of such passages in a clean text below which a passage is reported.
LEAST_E = 0.01

_WORDS = re.compile(r"[^\W\d_]+")
_MEMO = 200_000


@dataclass(frozen=True)
class Model:
    """Term scores, the rate and size constants of the extreme-value law, and the calibration."""

    terms: dict[str, float]
    rate: float = 1.0
    size: float = 1.0
    weights: tuple[float, float, float] | None = None

    def evidence(self, n, best):
        """Log of the inverse of the number of such segments expected in a clean text."""
        return self.rate * best - np.log(np.maximum(n, 1) * self.size)

    def score(self, n, best, total):
        if self.weights is None:
            return np.zeros(len(n))
        x = _features(self.evidence(n, best), total)
        return 1 / (1 + np.exp(-np.clip(x @ np.asarray(self.weights), -30, 30)))


def _features(evidence, total):
    return np.stack([np.ones(len(total)), np.clip(evidence, -5, 20), np.log1p(total)], 1)


class _Scores(dict):
    """word -> score, worked out once a worker for each word."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self._terms = terms

    def __missing__(self, word: str) -> float:
        own = self._terms.get(word)
        if own is None and len(word) > STEM:
            own = self._terms.get("^" + word[:STEM])
        self[word] = out = (own or 0.0) - TOKEN_COST
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past, score), in one pass.

    Candidates are kept with the running sums at their two ends. A new one is merged back to the
    nearest candidate that starts lower, while its own end is the higher. Each candidate knows the
    nearest one before it that starts lower; those between are never looked at again.
    """
    sums = np.cumsum(scores)
    out: list[tuple[int, int, float, float]] = []
    lower: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        first, left, right = i, float(sums[i] - scores[i]), float(sums[i])
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = lower[j]
            if j < 0 or out[j][3] >= right:
                out.append((first, i + 1, left, right))
                lower.append(j)
                break
            (first, _, left, _), before = out[j], lower[j]
            del out[j:], lower[j:]
            j = before
    return [(a, b, right - left) for a, b, left, right in out]


def _measure(texts, terms: dict[str, float], memo: list, passages: bool):
    """For each text: tokens, best segment, sum of segments, and the segments with their places."""
    if not memo or len(memo[0]) > _MEMO:
        memo[:] = [_Scores(terms)]
    get = memo[0].__getitem__
    for text in texts:
        words = _WORDS.findall((text or "").lower())
        scores = np.fromiter(map(get, words), float, len(words))
        found = segments(scores) if len(words) and scores.max() > 0 else []
        best, total = max((s for *_, s in found), default=0.0), sum(s for *_, s in found)
        yield len(words), best, total, found if passages else None


def _labelled(labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic of the rows a model may learn from: the remainder is not the held-out one."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(rows)


def held_out():
    return F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)
    )


def _term_scores(train: DataFrame) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Log-odds of toxic against clean text for each telling term; scores of clean text's tokens.

    A term counts once a document, so that one document's habits don't make a term telling.
    """

    def count(batches):
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            pairs = zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
            for text, toxic in pairs:
                words = set(_WORDS.findall((text or "").lower()))
                counts[toxic > 0].update(words)
                counts[toxic > 0].update({"^" + w[:STEM] for w in words if len(w) > STEM})
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([counts[1][x] for x in terms], pa.int64()),
                    pa.array([counts[0][x] for x in terms], pa.int64()),
                ],
                ["term", "toxic", "clean"],
            )

    rows = train.select("text", "toxic").mapInArrow(releasing(count), "term string, toxic long, clean long")
    sums = stored(rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    words = sums.filter("NOT startswith(term, '^')").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = words["t"] or 0, words["c"] or 0
    if not t or not c:
        return {}, []
    prior = F.lit(LEAST) + F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(float(t + c))

    def odds(n, total):
        return F.log((n + prior) / (F.lit(total + PRIOR) - n - prior))

    score = odds(F.col("toxic"), t) - odds(F.col("clean"), c)
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    share = (F.col("clean") + prior) / F.lit(c + PRIOR)
    told = sums.select("term", "clean", score.alias("score"), (score / spread).alias("z"), share.alias("share"))
    kept = told.filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "term").limit(MODEL_TERMS).collect()
    terms = {r["term"]: r["score"] for r in kept}
    law = [(r["share"], r["score"] - TOKEN_COST) for r in kept if r["term"][0] != "^"]
    return terms, law


def _rate(law: list[tuple[float, float]]) -> float:
    """The positive solution of sum(share * exp(rate * score)) = 1 over clean text's tokens."""
    shares, scores = np.array([a for a, _ in law]), np.array([b for _, b in law])
    rest = max(0.0, 1 - shares.sum())

    def excess(rate):
        return shares @ np.exp(rate * scores) + rest * math.exp(-rate * TOKEN_COST) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit by Newton steps, with a small ridge and smoothed labels."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, x.T @ (target - p) - ridge @ weights)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(weights.tolist())


def fit(docs: DataFrame, labels: DataFrame, rows: int = MODEL_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents; without both labels the model is empty."""
    small_batches(docs.sparkSession)
    train = docs.select("doc_id", "text").join(F.broadcast(_labelled(labels, rows)), "doc_id")
    terms, law = _term_scores(train)
    if not terms:
        return Model({})
    rate = _rate(law)

    def measure(batches):
        memo: list = []
        for batch in batches:
            found = list(_measure(batch.column("text").to_pylist(), terms, memo, False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                ],
                ["toxic", "n", "best", "total"],
            )

    got = train.select("text", "toxic").mapInArrow(releasing(measure), "toxic int, n long, best double, total double")
    got = got.collect()  # at most ``rows`` rows of four numbers
    got.sort()
    y, n, best, total = (np.array([r[k] for r in got], float) for k in range(4))
    clean = (y == 0) & (n > 0)
    if not clean.any() or clean.all():
        return Model({})
    size = clean.sum() / (n[clean] * np.exp(-rate * best[clean])).sum()
    model = Model(terms, rate, float(size))
    weights = _calibrate(_features(model.evidence(n, best), total), y > 0)
    return Model(terms, rate, float(size), weights)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """Each row as ``__row``, with toxic_score, toxic and passages."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    kind = rows.schema["__row"].dataType.simpleString()

    def run(batches):
        memo: list = []
        for batch in batches:
            texts = batch.column("__row").field("text").to_pylist()
            found = list(_measure(texts, model.terms, memo, True))
            n, best, total = (np.array([x[k] for x in found], float) for k in range(3))
            scores = model.score(n, best, total)
            told = [
                [
                    {"first": a, "past": b, "score": s}
                    for a, b, s in segs or ()
                    if model.evidence(size, s) > -math.log(LEAST_E)
                ]
                for size, *_, segs in found
            ]
            passage = pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__row"),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                    pa.array(told, pa.list_(passage)),
                ],
                ["__row", "toxic_score", "toxic", "passages"],
            )

    passages = "array<struct<first:int,past:int,score:double>>"
    return rows.mapInArrow(releasing(run), f"__row {kind}, toxic_score double, toxic int, passages {passages}")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with toxic_score, toxic and the toxic passages found.

    Each word scores its log-odds, or its stem's, less a constant; the linear scan finds every
    maximal scoring segment of the whole text. A passage, given in words, is reported when fewer
    than ``LEAST_E`` of its score are expected in a clean text of that length. The document's score
    calibrates the best segment's evidence and the segments' sum. Null and empty texts have no
    segment and get the score of such texts; an empty model scores 0. Repeated rows score alike;
    columns of ``docs`` with the new names are replaced. An empty table gives an empty result.
    """
    new = ("toxic_score", "toxic", "passages")
    kept = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return _scored(docs, model).select(*kept, *new)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not judged toxic, with their columns."""
    return _scored(docs, fit(docs, labels)).filter("toxic = 0").select("__row.*")
