"""Token ids of whole texts by a public tokenizer, a word at a time from a bounded memory."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from posttide.llm import anchors as an

# Words remembered by a worker twice, as newer and older ones, and the longest that is, in bytes.
WORDS_KEPT, LONGEST_KEPT = 500_000, 64

# Bytes of texts whose words are looked up together.
_TOGETHER = 2 << 20

# A space between two white-space characters belongs to their run; the text is then not cut.
_RUN = re.compile(r"\s (?:\s|$)")
# What a word must not hold to be told apart in a line: white space; and where texts are normalized,
# the mark's digit, and marks that combine with what stands before them.
_BLANK, _ODD = re.compile(r"\s"), re.compile(r"[\s0\u0300-\u036f]")

# How byte-level vocabularies write a space.
_SPACE = "\u0120"

# New words that are encoded as one line.
_LINE = 256


class _Memory:
    """Words met before and their ids, side by side in arrays, found by the words' hashes."""

    def __init__(self):
        self.hashes, self._index = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._words, self._first = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self._size, self._begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple:
        """Which of the words are here, where their ids begin, and how many there are."""
        at = np.searchsorted(self.hashes, hashes)
        here = np.flatnonzero(at < len(self.hashes))
        here = here[self.hashes[at[here]] == hashes[here]]
        index = self._index[at[here]]
        alike = self._size[index] == size[here]
        here, index = here[alike], index[alike]
        spans = _spread(first[here], size[here]), _spread(self._first[index], size[here])
        differs = data[spans[0]] != self._words[spans[1]]
        if differs.any():  # another word with the same hash: not here
            of = np.repeat(np.arange(len(here)), size[here])
            alike = np.bincount(of[differs], minlength=len(here)) == 0
            here, index = here[alike], index[alike]
        return here, self._begin[index], self._count[index]

    def add(
        self, hashes: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray
    ) -> None:
        """Words in the order of their hashes, and their ids, one word's behind the other's."""
        index = np.arange(len(self._size), len(self._size) + len(size), dtype=np.int32)
        joined = np.concatenate([self.hashes, hashes])
        order = np.argsort(joined, kind="stable")
        self.hashes, self._index = joined[order], np.concatenate([self._index, index])[order]
        self._first = np.concatenate([self._first, len(self._words) + np.cumsum(size) - size])
        self._words = np.concatenate([self._words, data[_spread(first, size)]])
        self._begin = np.concatenate([self._begin, len(self.ids) + np.cumsum(count) - count])
        self.ids = np.concatenate([self.ids, ids])
        self._size, self._count = np.concatenate([self._size, size]), np.concatenate([self._count, count])


class Encoder:
    """Encodes texts as the tokenizer does, looking repeated words up.

    Two kinds of tokenizers never build a token across the start of a space: byte-level ones, whose
    tokens may begin with one space, and those that drop white space. Their texts are cut there,
    and only words not met before are encoded, each at most once in two megabytes of texts. Texts
    of other tokenizers, and texts that hold a special token or a run of white space around a space,
    are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before = described.get("pre_tokenizer") or {}
        normal = json.dumps(described.get("normalizer"))
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True)
        split = (before.get("pretokenizers") or [{}])[0]
        drops = split.get("behavior") == "Removed" and split.get("invert") is True
        self._spaced = byte_level and not before.get("add_prefix_space") and normal == "null"
        self._dropped = drops and r"\\s+" in normal
        self._special = [t["content"] for t in described.get("added_tokens", [])]
        self._opens = np.zeros(max(self._tokenizer.get_vocab().values(), default=0) + 1, bool)
        self._opens[[i for x, i in self._tokenizer.get_vocab().items() if x.startswith(_SPACE)]] = True
        self._blank = np.zeros(256, bool)
        self._blank[[*range(9, 14), *range(28, 33), *[48] * self._dropped]] = True
        self._newer, self._older = _Memory(), _Memory()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _lines(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words and how many each has, encoded many words to a line.

        Words are told apart by a mark behind each that none of them holds; without one, each
        begins with a space, and its first token alone does so too.
        """
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        past = np.cumsum(size + len(mark))
        line = np.empty(past[-1], np.uint8)
        line[_spread(past - size - len(mark), size)] = data[_spread(first, size)]
        for k, byte in enumerate(mark):
            line[past - len(mark) + k] = byte
        cuts, whole = [0, *past[_LINE - 1 :: _LINE].tolist()], line.tobytes()
        if cuts[-1] < len(whole):
            cuts.append(len(whole))
        texts = [whole[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, dtype=np.uint32) for x in found])
        if not mark:
            return ids, np.diff(np.flatnonzero(self._opens[ids]), append=len(ids))
        marks = ids == self._tokenizer.encode(mark.decode(), add_special_tokens=False).ids[0]
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _plain(self, data: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Which words can be told apart in a line."""
        blanks = np.concatenate([[0], np.cumsum(self._blank[data], dtype=np.int32)])
        others = np.concatenate([[0], np.cumsum(data > 127, dtype=np.int32)])
        plain = (past > first) & (blanks[past] == blanks[first])
        some = np.flatnonzero(plain & (others[past] > others[first]))
        for i in range(0, len(some), _LINE):
            part = some[i : i + _LINE]
            size = past[part] - first[part]
            if not self._told_apart(data[_spread(first[part], size)].tobytes().decode()):
                words = (data[a:b].tobytes().decode() for a, b in zip(first[part], past[part], strict=True))
                plain[part] = [self._told_apart(word) for word in words]
        return plain

    def _encode_words(self, data: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one word's behind the other's, and how many each has."""
        spaced = (past > first) & (data[np.minimum(first, len(data) - 1)] == 32)  # the last may be empty
        plain = self._plain(data, first + spaced, past)
        kinds = [np.flatnonzero(plain & spaced), np.flatnonzero(plain & ~spaced), np.flatnonzero(~plain)]
        marks = (b"" if self._spaced else b" 0 ", b"\n" if self._spaced else b" 0 ")
        parts = [
            self._lines(data, first[at], past[at] - first[at], mark) for at, mark in zip(kinds, marks, strict=False)
        ]
        odd = self._encode([data[a:b].tobytes().decode() for a, b in zip(first[kinds[2]], past[kinds[2]], strict=True)])
        parts.append((np.frombuffer(b"".join(odd), "<u4"), np.array([len(x) >> 2 for x in odd], np.int64)))
        place, counts = np.concatenate(kinds), np.concatenate([x for _, x in parts])
        begin, order = np.cumsum(counts) - counts, np.argsort(place)
        ids = np.concatenate([x for x, _ in parts])
        return ids[_spread(begin[order], counts[order])], counts[order]

    def _told_apart(self, text: str) -> bool:
        if self._spaced:
            return not _BLANK.search(text)
        return not _ODD.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def _is_cut(self, text: str) -> bool:
        if any(x in text for x in self._special):
            return False
        return self._dropped or self._spaced and not (" " in text and _RUN.search(text))

    def _words(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end in texts that stand one after another, none of them empty.

        A word of a byte-level tokenizer holds the space before it. White space that ends in a line
        break has that break for its last token, so a break before a letter stands alone; and white
        space behind a letter begins a token.
        """
        begins = data == 32
        if self._dropped:
            begins |= data == 10
            gaps = begins.copy()
        else:
            line, seen = np.flatnonzero(data == 10), (data > 32) & (data < 128)
            after, before = line + 1, line - 1
            inside = np.isin(after, edges, invert=True)
            last = line[inside & seen[after % len(data)]]
            begins[last] = begins[last + 1] = True
            begins[line[seen[before]]] = True
        begins[edges[:-1]] = True
        first = np.flatnonzero(begins)
        past = np.append(first[1:], len(data))
        return (first + gaps[first] if self._dropped else first), past

    def _looked_up(self, hashes: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple:
        """A table of ids, and where in it each of the different words begins and how many ids it
        has, from memory where they are there. Words come in the order of their hashes."""
        if len(self._newer.hashes) > WORDS_KEPT:
            self._newer, self._older = _Memory(), self._newer
        begin, count = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        here, at, n = self._newer.find(hashes, data, first, size)
        begin[here], count[here] = at, n
        new = np.ones(len(first), bool)
        new[here] = False
        rest = np.flatnonzero(new)
        old, at, n = self._older.find(hashes[rest], data, first[rest], size[rest])
        moved = self._older.ids[_spread(at, n)]
        old, rest = rest[old], np.delete(rest, old)
        ids, counts = self._encode_words(data, first[rest], first[rest] + size[rest])
        fresh, ids = np.concatenate([old, rest]), np.concatenate([moved, ids])
        counts = np.concatenate([n, counts])
        begin[fresh] = len(self._newer.ids) + np.cumsum(counts) - counts
        count[fresh] = counts
        table = np.concatenate([self._newer.ids, ids])
        kept = fresh[size[fresh] <= LONGEST_KEPT]
        kept.sort()
        kept_ids = table[_spread(begin[kept], count[kept])]
        self._newer.add(hashes[kept], data, first[kept], size[kept], kept_ids, count[kept])
        return table, begin, count

    def _cut_ids(self, texts: list[str], coded: list[bytes]) -> list[bytes]:
        """Ids of texts that are cut into words: different words are looked up once, then spread."""
        whole = b"".join(coded)
        data = np.frombuffer(whole, np.uint8)
        edges = np.cumsum([0, *map(len, coded)])
        first, past = self._words(data, edges)
        hashes = an.span_hashes(*an.prefix_hashes(data), first, past)
        different, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = past - first
        if not _same(data, first, size, one[which]):  # two words with one hash
            return self._encode(texts)
        table, begin, counts = self._looked_up(different, data, first[one], size[one])
        flat = table[_spread(begin[which], counts[which])].astype("<u4", copy=False).tobytes()
        tokens = np.concatenate([[0], np.cumsum(counts[which])])
        cuts = (4 * tokens[np.searchsorted(past, edges, "right")]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        together: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            at = [i for i, _ in together]
            for i, ids in zip(at, self._cut_ids([texts[i] for i in at], [x for _, x in together]), strict=True):
                out[i] = ids
            together.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._is_cut(text):
                out[i] = self._encode([text])[0]
                continue
            coded = text.encode()
            if together and held + len(coded) > _TOGETHER:
                flush()
                held = 0
            together.append((i, coded))
            held += len(coded)
        if together:
            flush()
        return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _same(data: np.ndarray, first: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span holds the bytes of the span it is taken for."""
    if not np.array_equal(size, size[like]):
        return False
    return np.array_equal(data[_spread(first, size)], data[_spread(first[like], size)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
