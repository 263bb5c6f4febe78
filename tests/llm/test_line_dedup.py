"""Cuckoo filters, line de-duplication and its undoing, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from posttide.llm import line_dedup
from posttide.llm.cuckoo import Cuckoo

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("room", [2.0, 1.0, 0.6])
def test_filter_takes_and_forgets(room):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    keys = np.r_[keys, keys[:3], keys[:3]]
    cuckoo = Cuckoo.of_size(int(len(keys) * room))
    for part in np.array_split(keys, 3):
        cuckoo.take(part)
        cuckoo = Cuckoo.from_bytes(*cuckoo.to_bytes())
    assert (room >= 0.8) or len(cuckoo.stash)
    assert cuckoo.holds(keys).all()
    assert (cuckoo.slots != 0).sum() + len(cuckoo.stash) == len(keys)
    other = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert cuckoo.holds(other).mean() < 0.01
    cuckoo.forget(keys[:2500])
    assert cuckoo.holds(keys[2500:]).all()
    assert cuckoo.holds(keys[10:2500]).mean() < 0.01
    cuckoo.forget(keys[2500:])
    assert not cuckoo.slots.any() and not len(cuckoo.stash)


def brute(rows):
    key = lambda line: line.strip(SPACE).translate(UPPER)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc_id)
    owner = {k: min(v, key=lambda i: (i is None, i)) for k, v in holders.items() if len(v) > 1}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == doc_id]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(kept), digest, "\n".join(kept)))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(6)
    pool = [f"Line number {i} of a pool" for i in range(60)] + ["short", "", " \t ", "Ünïcode ÄÖ line", "ten chars."]
    rows = []
    for i in rng.sample(range(1000), 120):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own {i} {j} of this text" for j in range(rng.randint(0, 9))]
        lines = [x if rng.random() < 0.7 else f"  {x.upper()}\t\r" for x in lines] + ["The hot line of all documents"] * (i % 3)
        rows.append((i, "\n".join(lines)))
    rows += [(None, "Line number 3 of a pool\nonly null has it"), (None, "only null has it\n\n"), (2000, None), (2001, "")]
    rows += [(2002, "twice here, twice\ntwice here, twice"), (rows[0][0], rows[0][1]), (rows[1][0], "Line number 5 of a pool\nx\n")]
    rows += [(2003, "nine char\nnine char"), (2004, "nine char"), (2005, "y  line\x85here\n" * 2000), (2006, "Y  line\x85here ")]
    return rows


@pytest.mark.parametrize("increments", [1, 2, 4])
def test_rows_equal_brute_force(docs_of, increments, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 100)
    rows = _rows()
    got = line_dedup.deduplicate(docs_of(rows, at="x", t1="y"), increments).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def _state(index):
    return sorted(map(str, index.refs.collect())), sum(r.held for r in index.filters.collect())


def test_removed_documents_leave_no_trace(docs_of):
    rows = _rows()
    first, second = rows[:70], [r for r in rows[70:] if r[0] not in {i for i, _ in rows[:70]}]
    both = line_dedup.LineIndex.empty(docs_of([(1, "")]).sparkSession, 3).insert(docs_of(first)).insert(docs_of(second))
    ids = docs_of([(i, "") for i, _ in second] + [(99_999, "")])
    undone = both.remove(ids)
    assert _state(undone) == _state(line_dedup.index_of(docs_of(first), 1))
    got = line_dedup.keep_lines(docs_of(first), undone).collect()
    assert sorted(map(tuple, got), key=str) == brute(first)
    again = undone.insert(docs_of(second))
    got = line_dedup.keep_lines(docs_of(first + second), again).collect()
    assert sorted(map(tuple, got), key=str) == brute(first + second)
    assert _state(again) == _state(both)


def test_hot_keys_and_empty_table(docs_of, spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)
    rows = [(i, f"the same line everywhere\nown line of {i}") for i in range(300)]
    got = line_dedup.deduplicate(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    empty = spark.createDataFrame([], T.StructType(docs_of([(1, "")]).schema.fields))
    assert line_dedup.deduplicate(empty).collect() == []
