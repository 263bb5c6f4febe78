from __future__ import annotations

import math
import os
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from posttide.ml import classifier as cl
from posttide.ml import features as ft
from posttide.operators import corpus as co
from posttide.plans import jobs
from posttide.plans.scorers import load_or_train, ml_scorer
from posttide.sources import labeled

SEED = """text,label
What a lovely bright kitchen,positive
Great soup and kind waiters,positive
The walk along the shore was a joy,positive
Cold soup and rude waiters,negative
The roof leaks and nobody cares,negative
An awful walk in freezing rain,negative
The shop opens at nine,neutral
There are two roads to the shore,neutral
The kitchen has a table,neutral
"""


def write(path, text, age):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    return path


def test_training_paths_and_merge(spark, tmp_path):
    seed = write(tmp_path / "processed" / "seed.csv", "text,label\nWarm bread every day,positive\nStale bread again,negative\n", 30)
    old = write(tmp_path / "processed" / "older.csv",
                "cleaned_text,sentiment_label,sentiment_confidence,sentiment_score\n"
                "warm bread every day,positive,0.8,0.7\nstale bread again,negative,0.9,-0.8\nNA,positive,1,1\nx y,weird,1,1\n", 20)
    new = write(tmp_path / "processed" / "new file+1.csv", "content,sentiment_label\n\"so, so\",neu\n", 10)
    write(tmp_path / "processed" / "notes.csv", "a,b\n1,2\n", 5)
    files = labeled.training_paths(spark, None, str(seed), str(tmp_path / "processed"))
    names = [os.path.basename(f) for f in files]
    assert names == ["seed.csv", "notes.csv", "new file+1.csv", "older.csv"]
    assert len(labeled.training_paths(spark, str(old), str(seed), str(tmp_path))) == 1
    corpus = {r["text"]: r for r in labeled.training_corpus(spark, files).collect()}
    assert set(corpus) == {"Warm bread every day", "Stale bread again", "so, so"}
    love = corpus["Warm bread every day"]
    assert love["sample_weight"] == pytest.approx(4.3552)
    assert corpus["Stale bread again"]["sample_weight"] == pytest.approx(4.53065)
    assert love["support"] == 2 and love["source_kinds"] == ["manual_labels", "processed_export"]
    assert sorted(os.path.basename(p) for p in love["source_paths"]) == ["older.csv", "seed.csv"]
    assert corpus["so, so"]["sample_weight"] == pytest.approx(0.541875)
    with pytest.raises(FileNotFoundError):
        labeled.training_corpus(spark, [str(tmp_path / "processed" / "notes.csv")])
    with pytest.raises(ValueError):
        labeled.training_corpus(spark, [str(new)])


def test_vote_ties(spark):
    rows = [("a A", "positive", 1.0, 0), ("A a", "negative", 1.0, 1), ("b", "neutral", 0.5, 2),
            ("b", "positive", 0.25, 3), ("B", "positive", 0.25, 4), ("straße", "neutral", 1.0, 5),
            ("STRASSE", "positive", 3.0, 6)]
    frame = spark.createDataFrame(rows, "text string, label string, sample_weight double, n int")
    frame = frame.select("text", "label", "sample_weight", F.lit("p").alias("source_path"),
                         F.lit("k").alias("source_kind"), F.struct("n").alias("_order"))
    got = {r["text"]: (r["label"], r["support"]) for r in co.merge_frames([frame]).collect()}
    # Equal weight and support: first label; equal weight: larger support; copies fold to one key.
    assert got == {"a A": ("negative", 1), "b": ("positive", 2), "STRASSE": ("positive", 1)}


def test_texts_move_once_before_their_terms_are_counted(spark):
    df = spark.createDataFrame([("a", "Éa ab")], "id string, text string")
    plan = ft.term_counts(df, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and all("REPARTITION_BY_NUM" in line for line in moved)  # one for each block


def test_term_counts_agree_with_plain_counting(spark):
    texts = ["Café déjà vu, Café!", "a bb ccc  dddd\n", "", "ÀÉ x_1 ²"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in ft.term_counts(df, ["id"], "text").collect():
        if r["term"] is not None:
            got.setdefault((r["id"], r["block"]), {})[r["term"]] = r["tf"]
    for i, text in enumerate(texts):
        low = text.lower()
        plain = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        import re
        toks = re.findall(r"\w\w+", plain)
        want = Counter(toks) + Counter(f"{a} {b}" for a, b in zip(toks, toks[1:]))
        assert got.get((i, "word"), {}) == dict(want)
        grams = Counter()
        for word in low.split():
            padded = f" {word} "
            for n in (3, 4, 5):
                grams.update(padded[j:j + n] for j in range(len(padded) - n + 1))
        assert got.get((i, "char"), {}) == dict(grams)


def test_metrics_and_selection(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, predicted string")
    row = cl.fold_metrics(rows).first()
    assert row["accuracy"] == pytest.approx(0.5)
    assert row["macro_f1"] == pytest.approx((2 * 1 / 4 + 2 * 1 / 3 + 0.0) / 3)

    def chosen(first, second):
        tried = [("word_bigram_logreg", 2, *first), ("word_char_logreg", 2, *second)]
        return cl.selected_candidate(spark.createDataFrame(tried, cl._METRICS))

    assert chosen((None, None), (None, None)) == "word_char_logreg"
    assert chosen((0.5, 0.5), (0.5, 0.5)) == "word_bigram_logreg"
    assert chosen((0.5, 0.5), (0.5, 0.6)) == "word_char_logreg"
    assert chosen((0.5, None), (None, 0.6)) == "word_bigram_logreg"


def test_folds_are_stratified(spark):
    rows = spark.range(103).select("id", F.when(F.col("id") < 90, "hot").otherwise("cold").alias("label"))
    placed = cl.stratified_folds(rows, "label", ["id"], 4, 2)
    sizes = placed.groupBy("label").pivot("fold").count().collect()
    for row in sizes:
        counts = [row[str(f)] for f in range(4)]
        assert max(counts) - min(counts) <= 1


def test_train_save_load_predict(spark, tmp_path):
    seed = write(tmp_path / "seed.csv", SEED, 1)
    model = jobs.train_job(spark, str(tmp_path / "model"), explicit=str(seed))
    assert model.metadata["artifact_version"] == 2
    assert model.metadata["training_examples"] == 9
    assert model.metadata["label_distribution"] == {"positive": 3, "negative": 3, "neutral": 3}
    assert model.metadata["source_kinds"] == ["manual_labels"]
    assert {m["folds"] for m in model.metadata["candidate_metrics"].values()} == {3}
    loaded = load_or_train(spark, str(tmp_path / "model"), "unused")
    assert loaded.metadata == model.metadata
    assert cl.candidate_scores(loaded.metadata, spark).count() == 2
    texts = [(1, "lovely soup and kind waiters"), (2, ""), (3, "zzz qqq"), (4, "awful cold rain")]
    df = spark.createDataFrame(texts, "id int, cleaned_text string")
    got = {r["id"]: r for r in loaded.predict(df, ["id"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["label"] == "positive" and got[1]["score"] > 0
    assert got[4]["label"] == "negative" and got[4]["score"] < 0
    for r in got.values():
        assert 0.0 <= r["confidence"] <= 1.0 and -1.0 <= r["score"] <= 1.0
        if r["probabilities"] is not None:
            assert sum(r["probabilities"].values()) == pytest.approx(1.0)
    assert (got[2]["label"], got[2]["score"], got[2]["confidence"], got[2]["probabilities"]) == ("neutral", 0.0, 1.0, None)
    meta = ml_scorer(loaded)(df, ["id"]).filter("id = 1").first()["metadata"]
    assert "probabilities" in meta and "selected_model" in meta
    with pytest.raises(FileNotFoundError):
        load_or_train(spark, str(tmp_path / "none"), str(seed), auto_train=False)


def test_solver_reaches_the_stated_minimum(spark):
    """Gradient of C * sum(w * loss) + |b|^2 / 2 is near zero at the fitted coefficients."""
    texts = [("good fun", "positive"), ("good day", "positive"), ("bad day", "negative"), ("bad rain", "negative"), ("plain rain", "neutral")]
    df = spark.createDataFrame([(t, l, 1.0 + i) for i, (t, l) in enumerate(texts)], "text string, label string, sample_weight double")
    model = cl.train(df)
    labels = model.fitted.labels
    terms = {(r["block"], r["term"]): r for r in model.fitted.terms.collect()}
    counts = ft.term_counts(df.withColumn("id", F.col("text")), ["id"], "text").filter("term IS NOT NULL").collect()
    weights = {}
    for r in counts:
        if (r["block"], r["term"]) in terms:
            w = (1 + math.log(r["tf"])) * terms[(r["block"], r["term"])]["idf"]
            weights.setdefault((r["id"], r["block"]), {})[r["term"]] = w
    x = {}
    for (doc, block), ws in weights.items():
        norm = math.sqrt(sum(w * w for w in ws.values()))
        x.setdefault(doc, {}).update({(block, t): w / norm for t, w in ws.items()})
    n_label = Counter(l for _, l in texts)
    gradient = {key: list(row["coefficients"]) for key, row in terms.items()}
    for i, (text, label) in enumerate(texts):
        margins = [b + sum(v * terms[k]["coefficients"][j] for k, v in x[text].items()) for j, b in enumerate(model.fitted.intercepts)]
        top = max(margins)
        exps = [math.exp(m - top) for m in margins]
        weight = 4.0 * (1.0 + i) * len(texts) / (len(labels) * n_label[label])
        for j, lab in enumerate(labels):
            miss = exps[j] / sum(exps) - (1.0 if lab == label else 0.0)
            for k, v in x[text].items():
                gradient[k][j] += weight * miss * v
    assert max(abs(g) for row in gradient.values() for g in row) < 0.05


def test_two_labels_needed(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0)], "text string, label string, sample_weight double")
    with pytest.raises(ValueError):
        cl.train(df)
