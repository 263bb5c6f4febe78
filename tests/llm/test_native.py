"""Mixing, quality rules and sharding against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest

from posttide.llm import mixing, quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (None, "no id at all here", "b"),
    (3, "one two three", None),
    (3, "one two three", None),
    (4, " \t lead and trail \n", "b"),
    (5, "word " * 3000, "c"),
    (6, "naïve joined café", "c"),
]


def _many(n, sources="abcd"):
    return [(i, "w " * (1 + i * 7 % 23), sources[min(i % 7, len(sources) - 1)]) for i in range(n)]


@pytest.mark.parametrize("rows", [ODD, _many(300), [(i, "x y z", "hot") for i in range(90)] + _many(9)])
def test_mix_meets_targets(docs_of, rows):
    got = mixing.mix(docs_of(rows, size="s", target="t", taken="u")).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (i, len(WORD.findall(t or ""))) for i, t, _ in rows
    )
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    for s in names:
        assert r.source_size >= 0 and abs(taken[s] - target[s]) < 1
        assert target[s] <= 2 * size[s] + 1e-6
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    free = {round(target[s] / weight[s], 6) for s in names if target[s] < 2 * size[s] - 1e-6}
    assert len(free) <= 1


def test_mix_agrees_between_runs_and_partitions(docs_of):
    docs = docs_of(_many(200))
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_mixed_documents_hold_the_words_taken(docs_of):
    docs = docs_of([*ODD, *_many(60)], __slice="x", taken="y")
    taken = mixing.mix(docs).groupBy("doc_id").sum("taken").collect()
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken if v}


def test_mix_of_nothing(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mixed_documents(docs_of([])).count() == 0


def _base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_measures(spark, docs_of):
    texts = [
        *[t for _, t, _ in ODD],
        "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z",
        "same line\nsame line\n\n \nother # line |\nsame line",
        "a a a a a a",
        "a a a a a",
        "a b c d e a b c d e a b c d e",
    ]
    docs = docs_of([(i, t) for i, t in enumerate(texts)], n_words="x", score="y")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").limit(0)
    for r in quality.judge(docs, labels).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == _base(texts[r.doc_id]), texts[r.doc_id][:50]
        assert r.kept is (not r.base_failed)
    assert quality.judge(docs_of([]), labels).count() == 0


def test_quality_verdict_follows_trusted_rows(spark, docs_of):
    good = [f"the river runs past house {i % 9} and the old mill by the wood near town" for i in range(150)]
    bad = [f"XX{i}!! ZZ{i}## QQ{i}$$ WW{i}!! RR{i}%% TT{i}!! PP{i}## LL{i}!! KK{i}$$ JJ{i}!! HH{i}" for i in range(150)]
    docs = docs_of(list(enumerate(good + bad)))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    assert len(kept & set(range(150))) >= 147 and len(kept & set(range(150, 300))) <= 3


def test_quality_scores_trusted_texts_without_moving_texts(spark, docs_of, monkeypatch):
    """As where too many rows are trusted for a broadcast; one of them has no words."""
    texts = [f"the river runs past house {i % 9} and the old mill by the wood near town" for i in range(80)]
    docs = docs_of([*enumerate(texts), *[(i, " ") for i in range(80, 90)]])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    sides = []
    monkeypatch.setattr(quality, "lookup_side", lambda df: sides.append(df) or df)
    moved = []
    kind = type(docs)
    plain = kind.join
    monkeypatch.setattr(kind, "join", lambda a, b, *x: moved.append((a.columns, b)) or plain(a, b, *x))
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    assert len(kept) >= 75 and not kept & set(range(80, 90))
    assert sides and all("text" not in left for left, right in moved if right is sides[0])


def test_shards_and_slots(docs_of):
    rows = [*[(i, "t" * (i % 9)) for i in range(500)], *[(r[0], r[1]) for r in ODD]]
    got = sharding.shard(docs_of(rows, shard="x", slot="y", size="z")).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 16
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard(docs_of([])).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(docs_of):
    docs = docs_of([(i, "x") for i in range(2000)])
    for n in (4, 8, 12, 16, 20):
        moved = sharding.shard(docs, n).filter("shard <> grown_shard").collect()
        assert moved and {r.grown_shard for r in moved} == {n}
    for n in (0, 5, 17, 18):
        with pytest.raises(ValueError, match="multiple"):
            sharding.shard(docs, n)


def test_a_new_weight_moves_rows_only_into_its_subtree(spark):
    from pyspark.sql import functions as F

    before, after = sharding.tree(16), sharding.tree(16)
    after["region1"]["rack0"][5] = 3.0
    ids = spark.range(4000)
    key = F.col("id").cast("string")
    rows = ids.select(
        sharding.shard_column(key, before).alias("a"), sharding.shard_column(key, after).alias("b")
    ).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(4 <= b < 8 for _, b in moved)
