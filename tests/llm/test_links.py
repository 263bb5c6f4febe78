"""N-gram join, components, suffix ranks and search against brute force, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from posttide.llm import anchors, ngram_join, search, suffixes
from posttide.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sets(rows):
    out = []
    for i, text in rows:
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        out.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    return out


def _linked(rows):
    """(doc_id, set size, component) of each row, by comparing all pairs."""
    sets = _sets(rows)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is None or j is None or not a or not b:
                continue
            if i == j or 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, a) in enumerate(sets):
        if i is not None and a:
            least[root(x)] = min(least.get(root(x), i), i)
    return Counter((i, len(a), None if i is None else least[root(x)] if a else i) for x, (i, a) in enumerate(sets))


def _vocabulary(seed, n=4000):
    rng = random.Random(seed)
    return rng, ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def _edited(rng, words, vocabulary, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


def _corpus(copies):
    rng, vocabulary = _vocabulary(1)
    passage = rng.choices(vocabulary, k=60)
    rows = [(1000 + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f"])]
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(5, 300))
        if i % 2:
            words[2:2] = passage  # a passage that many texts share
        rows.append((10 * i, " ".join(words)))
        for k in range(i % 4):
            rows.append((10 * i + 1 + k, " ".join(_edited(rng, words, vocabulary, k * len(words) // 60))))
    base = rng.choices(vocabulary, k=150)
    for i in range(copies):  # copies with edits of their own: near the first, less near each other
        rows.append((5000 + i, " ".join(_edited(rng, base, vocabulary, i % 7))))
    return [*rows, (1, rows[20][1].upper()), (30, "clash of ids " * 3), (None, rows[20][1]), rows[30], rows[30]]


@pytest.mark.parametrize("copies", [5, 90])
def test_links_match_all_pairs(docs_of, copies):
    rows = _corpus(copies)
    got = ngram_join.link(docs_of(rows, node="x", n="y", hashes="z")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _linked(rows)


def test_groups_that_stay_undecided_are_compared_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    monkeypatch.setattr(ngram_join, "MORE", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_U", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_V", 8)
    monkeypatch.setattr(ngram_join, "PAIRS", 5)
    rows = _corpus(60)
    got = ngram_join.link(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _linked(rows)


def test_repeated_short_texts_list_all_their_shingles(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 10_000)
    rng, vocabulary = _vocabulary(3)
    phrase, rows = rng.choices(vocabulary, k=6), []
    for i in range(60):  # 4 and 3 shingles, of which all texts share 2
        more = rng.choices(vocabulary, k=2)
        longer, shorter = " ".join(phrase + more), " ".join(phrase + more[:1])
        rows += [(2 * i, longer), (2 * i, longer), (2 * i + 1, shorter)]
    got = ngram_join.link(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _linked(rows)


def test_one_of_each_component_stays(docs_of):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "x y z"), (2, "x y z"), (None, "a b c d e f"), (7, None), (8, "")]
    docs = docs_of(rows, component_id="x", rep="y")
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 7, 8]
    assert ngram_join.link(docs.limit(0)).count() == 0 and ngram_join.first_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (300, 200), (200, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 4, 90).astype(np.uint8)
    found = []
    for before in (0, 17, 400):
        data = np.concatenate([rng.integers(0, 4, before).astype(np.uint8), shared, rng.integers(0, 4, 33).astype(np.uint8)])
        anchor, first, last, key, _ = anchors.anchors(data, 40, 8)
        assert first[0] == 0 and last[-1] == len(data) - 40 and (first[1:] == last[:-1] + 1).all()
        inside = {(int(anchor[i] - p), int(p - before), int(key[i])) for i in range(len(anchor)) for p in range(first[i], last[i] + 1) if before <= p <= before + 50}
        found.append(inside)
    assert found[0] == found[1] == found[2] and len(found[0]) == 51


def _kept(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [20_000, 2])
def test_repeats_match_brute_force(docs_of, together):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdé ", k=70))
    texts = [None, "", "short", "é" * 25, passage * 4, "ab" * 100]
    for i in range(60):
        text = "".join(rng.choices("abcdé ", k=rng.randint(0, 400)))
        at = rng.randint(0, len(text))
        texts.append(text[:at] + passage[i % 9 : 70 - i % 11] + text[at:] if i % 3 else text)
    texts += [texts[10], texts[10], texts[20][3:]]
    docs = docs_of([(i, t) for i, t in enumerate(texts)], h1="x", n_bytes="y", spans="z")
    got = {r.doc_id: r for r in suffixes.deduplicate(docs, 40, 8, together).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(_kept(texts, 40)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_without_repeats_keeps_rows_and_columns(docs_of):
    line = "a line of some length that stands in both texts, word for word; " * 4
    docs = docs_of([(1, "x " + line + "y"), (None, line), (3, "own"), (3, "own"), (4, None)], kept="q", h2="w")
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    # The first row repeats the line's strings from their second character on.
    assert sorted((r.text, r.kept) for r in out.collect())[0] == ("", "q") and out.count() == 5
    assert suffixes.deduplicate(docs.limit(0)).count() == 0


def _best(rows, k):
    ok = [
        (i, [int(np.floor(64 * float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in {i: v for i, v in ok if i % 20 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "RANGE", 40)
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "QUERIES", 6)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 6).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)]  # one vector many times: ties go to the smaller id
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0]), (404, [9.0]), (405, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = search.top_k(vectors, F.col("vec_id") % 20 == 0, 20).collect()
    assert {tuple(r) for r in found} == _best(rows, 20) and len(found) == 20 * 20
    assert search.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in search.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, 64 * 128)]


def test_search_pairs_never_pass_through_the_driver(spark, monkeypatch):
    rows = [(i, [(i % 7) / 7, (i % 11) / 11]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans, plain = {}, search.stored
    monkeypatch.setattr(
        search, "stored", lambda df, name: (plans.update({name: df._jdf.queryExecution().toString()}), plain(df, name))[1]
    )
    found = search.top_k(vectors, F.col("vec_id") % 20 == 0, 5).collect()
    assert {tuple(r) for r in found} == _best(rows, 5)
    assert "BroadcastHashJoin" not in plans["found"] and "SortMergeJoin" in plans["found"]


@pytest.mark.parametrize("size", [1e8, 1e18])
def test_large_scores_stay_whole(spark, size):
    rows = [(0, [size, 1.0]), (1, [1.0, 3.0]), (2, [-1.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in search.top_k(vectors, F.col("vec_id") == 0, 5).collect()}
    # Beyond 64 bits scores stop at the ends of the range.
    big = min(int(64 * size), 2**63 - 1)
    assert got == {1: min(64 * big + 64 * 192, 2**63 - 1), 2: max(-64 * big + 64 * 192, -(2**63))}


def test_pipeline_stages_hand_on_documents(spark, docs_of, tmp_path):
    import corpus_pipeline

    rng, vocabulary = _vocabulary(9)
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=80)
        if i % 5 == 0:
            words[10:14] = ["vilefoo", "vilebar", "nastybaz", "vilefoo"]
        rows.append((i, " ".join(words), "ab"[i % 2]))
    rows += [(100, rows[1][1], "a"), (101, rows[1][1] + " end", "b"), (102, None, "a"), (None, "", "a"), (103, "", None)]
    docs_of(rows, toxic="t", h1="u").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
    assert not {0, 5, 10} & set(kept["toxicity"]) and {1, 2, 3, 102, 103, None} <= set(kept["toxicity"])
    assert {100, 101} & set(kept["near_copies"]) == set() and 1 in kept["near_copies"]
    assert sorted(map(str, kept["repeats"])) == sorted(map(str, kept["near_copies"]))
    assert set(kept["packing"]) == set(kept["mixing"]) <= set(kept["repeats"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in again.collect()) == sorted(map(str, kept["packing"]))
