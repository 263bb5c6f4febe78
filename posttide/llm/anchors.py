"""Positions that content alone picks: one or more inside every string of a given length."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer: equal in, equal out, close in, far out."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES = {int(_ODD): np.zeros(0, np.uint64), pow(int(_ODD), -1, 1 << 64): np.zeros(0, np.uint64)}


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept up to a bounded length."""
    out = []
    for base, table in list(_TABLES.items()):
        if len(table) < n:
            table = _powers(base, max(n, 1 << 16))
            if len(table) <= 1 << 20:
                _TABLES[base] = table
        out.append(table[:n])
    return out


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial sums of all prefixes modulo 2^64, and the inverse powers that align spans."""
    n = len(data)
    powers, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[:n], out=sums[1:])
    return sums, inverse


def span_hashes(sums: np.ndarray, inverse: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A hash of each span that does not depend on where it stands."""
    return mixed((sums[past] - sums[first]) * inverse[first] + (past - first).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value in each window of ``width`` values."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    best, index, reach = values, at, 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        index = np.where(take, index[step:], index[:-step])
        reach += step
    return index[:n]


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, key, context) of a text: the strings of ``length`` bytes that start at
    first to last have their anchor in common, the least hash of the ``gram`` bytes at any place
    inside. ``key`` hashes those bytes, ``context`` all bytes of the strings, and their place
    around the anchor. Equal strings have equal anchors, at the same distance."""
    sums, inverse = prefix_hashes(data)
    starts = np.arange(len(data) - gram + 1)
    grams = span_hashes(sums, inverse, starts, starts + gram)
    chosen = sliding_least(grams, length - gram + 1)
    edges = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges, [len(chosen)]]) - 1
    anchor = chosen[first]
    context = span_hashes(sums, inverse, first, last + length)
    context = mixed(context + (anchor - first).astype(np.uint64) * _ODD)
    return anchor, first, last, grams[anchor], context
