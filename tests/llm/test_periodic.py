"""Wavelet answers, periodic runs and what is left of a text, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from posttide.llm import periodic
from posttide.llm.wavelet import Wavelet

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_wavelet_counts_and_selects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 300):
        values = rng.permutation(n)
        tree = Wavelet(values)
        low, high = np.sort(rng.integers(0, n + 1, (2, 200)), axis=0)
        bound = rng.integers(0, n + 1, 200)
        want = [(values[a:b] < x).sum() for a, b, x in zip(low, high, bound, strict=True)]
        assert tree.less(low, high, bound).tolist() == want
        some = high > low
        low, high = low[some], high[some]
        nth = rng.integers(0, high - low)
        want = [np.sort(values[a:b])[i] for a, b, i in zip(low, high, nth, strict=True)]
        assert tree.nth(low, high, nth).tolist() == want


def brute_runs(words):
    """Every maximal stretch of every period; the least period of a stretch stays."""
    n, least = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                least.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in least.items())


def _sequences():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 100, list("ab") * 50 + list("ba") * 40]
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    out.append(list(fib[-1]))
    for _ in range(250):
        words = []
        for _ in range(rng.randint(1, 6)):
            unit = rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(1, rng.choice([3, 9, 40])))
            words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        if rng.random() < 0.5 and words:
            words[rng.randrange(len(words))] = "x"
        out.append(words)
    for size in (7, 8, 9, 15, 16, 17, 31, 32, 33):  # stretches of one letter inside longer periods
        out.append((["a"] * size + ["b"]) * 4 + ["a"] * (size // 2))
        out.append(((["a"] * size + ["b"]) * 3 + ["c"]) * 4)
    return out


def test_runs_equal_brute_force_together_and_alone():
    texts = _sequences()
    want = [brute_runs(x) for x in texts]
    assert sum(map(len, want)) > 200
    together = periodic.document_runs([[w.encode() for w in x] for x in texts])
    assert [[tuple(r) for r in runs.tolist()] for runs in together] == want
    for words, runs in zip(texts[::9], want[::9], strict=True):
        assert [tuple(r) for r in periodic.document_runs([[w.encode() for w in words]])[0].tolist()] == runs


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_query_rows_equal_brute_force(docs_of, chunk):
    rng = random.Random(5)
    rows = [(i, " ".join(x)) for i, x in enumerate(_sequences())]
    rows += [(1000 + i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 400)))) for i in range(60)]
    rows += [(None, None), (5000, None), (5001, ""), (5002, " \t\n\x0b "), (7, "a b   " * 40), (7, "x " * 30)]
    rows += [(None, "b a " * 20), (6000, "long " + " ".join(str(i % 977) for i in range(40_000)))]
    got = [tuple(r)[:8] for r in periodic.find_runs(docs_of(rows, length="x", period="y"), chunk).collect()]
    key = lambda r: [(x is None, x) for x in r]
    brute = [expected(*r) for r in rows[:-1]]
    long = [r for r in got if r[0] == 6000]
    assert sorted([r for r in got if r[0] != 6000], key=key) == sorted(brute, key=key)
    assert len(long) == 1 and long[0][1] >= 1


def test_empty_table(docs_of, spark):
    assert periodic.find_runs(spark.createDataFrame([], T.StructType(docs_of([(1, "")]).schema.fields))).collect() == []
