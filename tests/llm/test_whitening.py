"""Whitening against an eigendecomposition of the exact covariance."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from posttide.llm import whitening

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("component", T.StringType()),
    ]
)


def whitened(spark, rows, most=32):
    docs = spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], VECTORS)
    return whitening.whiten(docs, most).collect()


def exact(rows):
    """x, n, S, and the covariance, in whole numbers and fractions."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[n * a - b for a, b in zip(v, s, strict=True)] for v in x], dtype=object)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in (d.T @ d)])
    return x, n, s, d, cov


def check(spark, rows, most=32):
    got = whitened(spark, rows, most)
    x, n, s, d, cov = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > 1e-13 * values[0]).sum()))
    assert len(got) == n * kept
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for i, (vec_id, _) in enumerate(rows):
        mine = by_id[vec_id]
        assert sorted(mine) == list(range(1, kept + 1))
        assert {r.deviation for r in mine.values()} == {int((d[i] ** 2).sum())}
    for c in range(1, kept + 1):
        w = np.array([by_id[i][c].whitened for i, _ in rows])
        assert by_id[rows[0][0]][c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-4)
        gaps = [abs(values[c - 1] - v) for k, v in enumerate(values) if k != c - 1]
        if min(gaps, default=1) > 1e-6 * values[0]:
            mean = np.array([float(Fraction(t, n)) for t in s])
            want = (np.array(x, float) - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-6


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)) * np.arange(1, 9))])
    check(spark, [(i, v) for i, v in enumerate(rng.normal(size=(200, 40)) @ rng.normal(size=(40, 40)))])
    check(spark, [(i, v) for i, v in enumerate(rng.normal(size=(80, 5)) * [1, 2, 3, 4, 5])], most=2)


def test_dimensions_that_follow_from_others_and_wide_ranges(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, size=(150, 4))
    rows = np.c_[base, base[:, 0] + base[:, 1], np.full(150, 7), base[:, 2] * 20, np.eye(150)[0] / 64]
    check(spark, [(i, v) for i, v in enumerate(rows)])


def test_rows_that_take_no_part_and_odd_tables(spark):
    fine = [(1, [0.5, 1.0]), (None, [3.0, -1.0]), (2, [0.0, 0.0]), (2, [0.0, 0.25])]
    out = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0])]
    got = whitened(spark, fine + out)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1)] * 2 + [(False, 2)] * 4 + [(True, 0)] * 2
    assert {r.n for r in got} == {4}
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])], out):
        assert whitened(spark, rows) == []
    short = whitened(spark, [(1, [1.0]), (2, [2.0, 1.0]), (3, []), (4, [0.0, 5.0])])
    full = whitened(spark, [(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 5.0])])
    key = lambda r: (r.vec_id, r.component)
    for a, b in zip(sorted(short, key=key), sorted(full, key=key), strict=True):
        assert a.deviation == b.deviation and a.whitened == pytest.approx(b.whitened)
    far = whitened(spark, [(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [0.0, 4.0])])
    assert {r.deviation for r in far if r.vec_id == 1} == {None}
