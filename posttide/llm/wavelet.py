"""A wavelet matrix over a permutation, asked for many ranges at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """A bit vector with counts per 64 bits: how many bits before a place are set."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self._words = words
        self._before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self._before[1:])

    def ones(self, place: np.ndarray) -> np.ndarray:
        at = place >> 6
        below = (_ONE << (place & 63).astype(np.uint64)) - _ONE
        return self._before[at] + np.bitwise_count(self._words[at] & below)


class Wavelet:
    """Answers, over ranges of ``values`` (numbers from 0 to len - 1), in one step a bit.

    A level holds one bit of every value, highest first, and sorts values by it, zeros first, so a
    range stays a range on the way down.
    """

    def __init__(self, values: np.ndarray):
        self._levels = []
        for bit in range(max(1, len(values).bit_length()) - 1, -1, -1):
            bits = (values >> bit) & 1
            zeros = np.flatnonzero(bits == 0)
            self._levels.append((bit, _Bits(bits), len(zeros)))
            values = np.concatenate([values[zeros], values[np.flatnonzero(bits)]])

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are below its bound; bounds up to len."""
        count = np.zeros(len(low), np.int64)
        for bit, bits, zeros in self._levels:
            a, b = bits.ones(low), bits.ones(high)
            up = (bound >> bit) & 1 == 1
            count += np.where(up, (high - b) - (low - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones in its range; ``n`` is below the range's size."""
        value = np.zeros(len(low), np.int64)
        for bit, bits, zeros in self._levels:
            a, b = bits.ones(low), bits.ones(high)
            below = (high - b) - (low - a)
            up = n >= below
            value |= up.astype(np.int64) << bit
            n = np.where(up, n - below, n)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return value
