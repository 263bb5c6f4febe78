from __future__ import annotations

import math
import random

import pytest

from posttide.functions import lexicon_words as words
from posttide.operators import lexicon as lex

LEXICON = words.SEED_LEXICON


def reference_score(text, rules):
    """Word-by-word reading of the published rules."""
    toks = text.split()
    out = []

    def at(i):
        return toks[i] if 0 <= i < len(toks) else None

    for i, tok in enumerate(toks):
        if tok in rules.boosters or (tok == "kind" and at(i + 1) == "of") or tok not in LEXICON:
            out.append(0.0)
            continue
        base = v = LEXICON[tok]
        if tok == "no" and at(i + 1) in LEXICON:
            v = 0.0
        p = [at(i - 1), at(i - 2), at(i - 3)]
        if p[0] == "no" or p[1] == "no" or (p[2] == "no" and p[0] in ("or", "nor")):
            v = base * -0.74
        for k in range(3):
            if p[k] is None or p[k] in LEXICON:
                continue
            boost = rules.boosters.get(p[k], 0.0) * (1.0, 0.95, 0.9)[k]
            v += -boost if v < 0 else boost
            if k == 0:
                if p[0] in rules.negations:
                    v *= -0.74
            elif k == 1:
                if p[1] == "never" and p[0] in ("so", "this"):
                    v *= 1.25
                elif p[1] == "without" and p[0] == "doubt":
                    pass
                elif p[1] in rules.negations:
                    v *= -0.74
            else:
                if (p[2] == "never" and p[1] in ("so", "this")) or p[0] in ("so", "this"):
                    v *= 1.25
                elif p[2] == "without" and "doubt" in (p[0], p[1]):
                    pass
                elif p[2] in rules.negations:
                    v *= -0.74
                back = [f"{p[0]} {tok}", f"{p[1]} {p[0]} {tok}", f"{p[1]} {p[0]}",
                        f"{p[2]} {p[1]} {p[0]}", f"{p[2]} {p[1]}"]
                for phrase in back:
                    if phrase in rules.idioms:
                        v = rules.idioms[phrase]
                        break
                if at(i + 1) and f"{tok} {at(i + 1)}" in rules.idioms:
                    v = rules.idioms[f"{tok} {at(i + 1)}"]
                if at(i + 2) and f"{tok} {at(i + 1)} {at(i + 2)}" in rules.idioms:
                    v = rules.idioms[f"{tok} {at(i + 1)} {at(i + 2)}"]
                for phrase in (f"{p[2]} {p[1]} {p[0]}", f"{p[2]} {p[1]}", f"{p[1]} {p[0]}"):
                    v += rules.booster_pairs.get(phrase, 0.0)
        if p[0] == "least" and "least" not in LEXICON and p[1] not in ("at", "very"):
            v *= -0.74
        out.append(v)
    if rules.contrast in toks:
        b = toks.index(rules.contrast)
        out = [s * 0.5 if i < b else s * 1.5 if i > b else s for i, s in enumerate(out)]
    total = sum(out)
    return total / math.sqrt(total * total + 15) if toks else 0.0


def scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, cleaned_text string")
    return {r["id"]: r for r in lex.score_texts(df, lex.seed_lexicon(spark), ["id"]).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_word_by_word_rules(spark, seed):
    rng = random.Random(seed)
    vocabulary = """love hate good no not never so this without doubt least at very but kind of sort
        extremely slightly hell the bomb yeah right to die for table nor or just enough like""".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    got = scores(spark, texts)
    rules = lex.Rules()
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i]["score"] == pytest.approx(reference_score(text, rules), abs=6e-5), text
        shares = got[i]["neg"] + got[i]["neu"] + got[i]["pos"]
        assert shares == pytest.approx(1.0, abs=2e-3)


def test_signs_and_empty(spark):
    got = scores(spark, [
        "i absolutely love this product it is amazing and delightful", "i do not love this",
        "terrible awful day", "the table stands", "",
    ])
    assert [got[i]["label"] for i in range(5)] == ["positive", "negative", "negative", "neutral", "neutral"]
    assert (got[4]["score"], got[4]["confidence"], got[4]["neu"]) == (0.0, 1.0, 1.0)
    assert got[3]["confidence"] == 1.0
