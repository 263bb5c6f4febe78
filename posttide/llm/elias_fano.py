"""Elias-Fano codes of ascending integers, with select from sampled positions."""

from __future__ import annotations

import struct

import numpy as np

# One of so many set bits has its position stored, as a 32-bit number.
SAMPLE = 256
_HEAD = struct.Struct("<QqBQQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(0, np.uint8)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def encode(values: np.ndarray) -> bytes:
    """Ascending integers, repeats allowed: about 2 + log2(range / count) bits each."""
    n = len(values)
    base = int(values[0]) if n else 0
    rest = values.astype(np.int64).astype(np.uint64) - np.uint64(base % (1 << 64))
    top = int(rest[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = _pack(rest & np.uint64((1 << width) - 1), width)
    places = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    packed = np.packbits(high, bitorder="little")
    samples = places[::SAMPLE].astype("<u4")
    head = _HEAD.pack(n, base, width, len(low), len(packed), len(samples))
    return head + low.tobytes() + packed.tobytes() + samples.tobytes()


class Decoder:
    """Reads one code from ``data``; ``size`` is the number of its bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.base, self.width, lows, highs, samples = _HEAD.unpack_from(data, at)
        start = at + _HEAD.size
        view = np.frombuffer(data, np.uint8)
        self._low = view[start : start + lows]
        self._high = view[start + lows : start + lows + highs]
        end = start + lows + highs
        self._samples = np.frombuffer(data, "<u4", samples, end)
        self.size = end + 4 * samples - at

    def _low_bits(self, i: int) -> int:
        first, shift = divmod(i * self.width, 8)
        last = (i + 1) * self.width + 7 >> 3
        whole = int.from_bytes(self._low[first:last].tobytes(), "little")
        return whole >> shift & (1 << self.width) - 1

    def select(self, i: int) -> int:
        """The i-th value, by scanning at most ``SAMPLE`` set bits from a sampled one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self._samples[i // SAMPLE])
        wanted = i % SAMPLE
        byte, first = place >> 3, place & 7
        while True:
            block = np.unpackbits(self._high[byte : byte + 64], bitorder="little")[first:]
            ones = np.flatnonzero(block)
            if wanted < len(ones):
                high = 8 * byte + first + int(ones[wanted]) - i
                return self.base + (high << self.width | self._low_bits(i))
            wanted, byte, first = wanted - len(ones), byte + 64, 0

    def values(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self._high, bitorder="little")) - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.width]
            shift = np.arange(self.width, dtype=np.uint64)
            out |= (bits.reshape(self.n, self.width).astype(np.uint64) << shift).sum(1, dtype=np.uint64)
        return (out + np.uint64(self.base % (1 << 64))).astype(np.int64)
