"""Periodic runs of words: internal pattern matching over dyadic blocks.

Positions are ranked by their first 1, 2, 4, .. words (prefix doubling), which gives the suffix
array and names every dyadic block. A wavelet tree over the suffix array then answers, for a block,
where it occurs next in the window behind it: a run whose period lies between the block's length
and twice that repeats the block at a distance of one period. Three or more occurrences in a window
form an arithmetic progression; then the ends of the two stretches that keep its difference say which
periods are possible. Each candidate is extended both ways by the ranks, exactly.

Documents lie one behind the other in chunks of words, closed by marks that occur once, so no match
crosses them. Spark deals documents to tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from posttide.llm.common import small_batches
from posttide.llm.wavelet import Wavelet

# A run has at least so many words, and at least so many periods.
SHORTEST, PERIODS = 24, 3
# The shortest block: a run of SHORTEST words holds one in its first words and again a period on.
BLOCK_BITS = 3
# An odd number that spreads bits when multiplied with.
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Words searched together; a longer document is searched alone, as a whole.
CHUNK = 1 << 18

_RUN_TYPES = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
    "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
    "collapsed": pa.string(),
}
_RUN_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string"
)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, from some place on made periodic in one document of ten, as its id's checksum says."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def _doubled(rank: np.ndarray, width: int) -> tuple[np.ndarray, bool]:
    """Ranks by twice as many words, and whether all differ: a rank is the number of positions
    that sort before."""
    n = len(rank)
    behind = np.full(n, -1, np.int64)
    if width < n:
        behind[: n - width] = rank[width:]
    key = rank.astype(np.int64) * (n + 1) + behind + 1
    order = np.argsort(key)
    sorted_keys = key[order]
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    starts = np.flatnonzero(first)
    out = np.empty(n, np.int32)
    out[order] = starts[np.cumsum(first) - 1]
    return out, len(starts) == n


class _Ranks:
    """Ranks of all positions by their first 2^k words, until all differ."""

    def __init__(self, ids: np.ndarray):
        counts = np.bincount(ids)
        self.n = len(ids)
        self.levels = [(np.cumsum(counts) - counts)[ids].astype(np.int32)]
        unique = False
        while not unique:
            rank, unique = _doubled(self.levels[-1], 1 << (len(self.levels) - 1))
            self.levels.append(rank)
        self.suffixes = np.argsort(self.levels[-1])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on (a < b)."""
        same = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + same, b + same
            inside = y + (1 << k) <= self.n
            rank = self.levels[k]
            same += (inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])).astype(np.int64) << k
        return same

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before ``a`` and ``b``, going back (a < b)."""
        same = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - same - (1 << k), b - same - (1 << k)
            inside = x >= 0
            rank = self.levels[k]
            same += (inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])).astype(np.int64) << k
        return same


def _ends(ranks: _Ranks, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretch that keeps ``period`` around ``at`` begins and ends."""
    return at - ranks.behind(at, at + period), at + period + ranks.ahead(at, at + period)


def _candidates(ranks: _Ranks, tree: Wavelet, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of blocks of 2^k words, for periods from 2^k to twice that.

    The shortest blocks also stand for all smaller periods: there the next occurrence says it.
    """
    size = 1 << k
    rank = ranks.levels[k]
    at = np.arange(0, ranks.n - size + 1, size)
    low = rank[at].astype(np.int64)
    counts = np.bincount(rank, minlength=ranks.n + 1)
    high = low + counts[low]
    found = []

    def add(mask, positions, periods):
        found.append((positions[mask], periods[mask]))

    at, low, high = (x[high - low > 1] for x in (at, low, high))
    near, mid, far = (tree.less(low, high, np.minimum(at + d, ranks.n)) for d in (1, size, 2 * size))
    if k == BLOCK_BITS:
        small = mid > near
        add(np.ones(small.sum(), bool), at[small], tree.nth(low[small], high[small], near[small]) - at[small])
    here = far > mid
    at, low, high, mid, far = (x[here] for x in (at, low, high, mid, far))
    one = tree.nth(low, high, mid)
    more = far - mid
    add(more < 3, at, one - at)
    add(more == 2, at, tree.nth(low, high, far - 1) - at)
    row = more > 2
    at, low, high, mid, one = (x[row] for x in (at, low, high, mid, one))
    step = tree.nth(low, high, mid + 1) - one
    left, right = _ends(ranks, at, step)
    there_left, there_right = _ends(ranks, one, step)
    apart = there_left > left  # one stretch over both has no run of a longer period in it
    add(apart, at, there_left - left)
    add(apart, at, there_right - right)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs_of(ids: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers as rows (start, length, period), by start, then period."""
    ranks = _Ranks(ids)
    tree = Wavelet(ranks.suffixes)
    found = [np.zeros((0, 3), np.int64)]
    # Beyond the last level every block is unique and has no second occurrence.
    for k in range(BLOCK_BITS, len(ranks.levels)):
        at, period = _candidates(ranks, tree, k)
        ok = (period > 0) & (at + period < ranks.n)
        at, period = at[ok], period[ok]
        start, end = _ends(ranks, at, period)
        long = end - start >= np.maximum(SHORTEST, PERIODS * period)
        found.append(np.stack([start[long], (end - start)[long], period[long]], 1))
    runs = np.concatenate(found)
    # The least period of a stretch is its own: any other that fits it is a multiple.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.zeros(0, bool)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _hopeful(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which documents hold a block of 2^BLOCK_BITS words twice; no other can hold a run.

    Blocks are told apart by a hash under the document's number: a collision costs time only.
    """
    out = np.zeros(len(bounds) - 1, bool)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    size = 1 << BLOCK_BITS
    if len(ids) < size:
        return out
    mixed = ids.astype(np.uint64) * _ODD
    mixed ^= mixed >> np.uint64(29)
    block = doc[: len(ids) - size + 1].astype(np.uint64) * _ODD
    for i in range(size):
        block = (block ^ mixed[i : len(ids) - size + 1 + i]) * _ODD
        block ^= block >> np.uint64(32)
    order = np.argsort(block)
    block = block[order]
    out[doc[order[1:][block[1:] == block[:-1]]]] = True
    return out


def document_runs(documents: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document's words."""
    none = np.zeros((0, 3), np.int64)
    sizes = np.array([len(x) + 1 for x in documents])
    words = [w for x in documents for w in (*x, None)]
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    marks = ids < 0
    ids[marks] = ids.max(initial=-1) + 1 + np.arange(marks.sum())
    bounds = np.r_[0, np.cumsum(sizes)]
    kept = np.flatnonzero(_hopeful(ids, bounds))
    out = [none] * len(documents)
    if not len(kept):
        return out
    ids = np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in kept])
    runs = runs_of(np.unique(ids, return_inverse=True)[1])
    starts = np.r_[0, np.cumsum(sizes[kept])]
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    for i, doc in enumerate(kept):
        mine = runs[owner == i] if len(kept) == 1 else runs[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
        out[doc] = mine - np.array([starts[i], 0, 0])
    return out


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _described(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    """A document's digest columns, and its text without the repeated words."""
    best = (None,) * 4
    if len(runs):
        for start, length, period in runs.tolist():
            # start and period rise, so only a larger exponent takes the place
            if best[0] is None or length * best[2] > best[1] * period:
                best = (start, length, period, 1000 * length // period)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist()).encode()
    text = b" ".join(words)
    return (doc_id, len(runs), *best, _sha256(listed), _sha256(text), text.decode())


def _chunks(sizes: list[int], most: int):
    """Slices of neighbouring documents of about so many words."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _searched(batches, chunk: int):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").to_pylist()
        # bytes are split at the six ASCII white-space characters and no others
        words = [planted((t or "").encode().split(), i) for i, t in zip(ids, texts, strict=True)]
        del texts
        for part in _chunks([len(x) for x in words], chunk):
            found = document_runs(words[part])
            rows = [_described(*x) for x in zip(ids[part], words[part], found, strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _RUN_TYPES.values(), strict=True)], list(_RUN_TYPES)
            )


def find_runs(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of every document, and its text with each run cut to its first period.

    Returns doc_id, n_runs, the run with the greatest exponent (start, length, period,
    exponent_milli; null without runs), runs_sha256 over all of them, and collapsed_sha256 over
    ``collapsed``. Null and empty texts have no words and no runs; rows that repeat an id are
    searched one by one; a null id is never made periodic; other columns are not carried. A
    document is held whole by one task, at any length; ``chunk`` words are searched together.
    """
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    small_batches(docs.sparkSession)
    return rows.mapInArrow(partial(_searched, chunk=chunk), _RUN_SCHEMA)
