"""A cuckoo filter that takes, finds and forgets many hashed keys at once."""

from __future__ import annotations

import numpy as np

SLOTS = 4
# Keys that a filter is made for fill at most this share of its slots.
_FULL = 0.8
# Rounds of moving fingerprints before what is left goes to the stash.
_ROUNDS = 200
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Cuckoo:
    """Sixteen-bit fingerprints in buckets of four; each key has two buckets it may lie in.

    A key's other bucket follows from its fingerprint, so fingerprints move without their keys.
    Every key taken adds one fingerprint, so forgetting keys that were taken, and no others, leaves
    the rest in place. What finds no slot is kept in a stash, so no key is ever lost.
    """

    def __init__(self, slots: np.ndarray, stash: np.ndarray):
        self.slots, self.stash = slots, stash

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(0, int(np.ceil(keys / (_FULL * SLOTS))) - 1).bit_length()
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros((0, 2), np.int64))

    @classmethod
    def from_bytes(cls, slots: bytes, stash: bytes) -> Cuckoo:
        return cls(
            np.frombuffer(slots, "<u2").reshape(-1, SLOTS).copy(), np.frombuffer(stash, "<i8").reshape(-1, 2)
        )

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.slots.astype("<u2").tobytes(), self.stash.astype("<i8").tobytes()

    @property
    def capacity(self) -> int:
        return int(_FULL * self.slots.size)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        moved = (mark.astype(np.uint64) * _SPREAD) >> np.uint64(20)
        return bucket ^ (moved & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _placed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and fingerprint (1 to 65535) of 64-bit hashes."""
        mixed = (keys.astype(np.uint64) ^ (keys.astype(np.uint64) >> np.uint64(31))) * _SPREAD
        mark = ((mixed >> np.uint64(48)) % np.uint64(65535)).astype(np.int64) + 1
        return (mixed & np.uint64(len(self.slots) - 1)).astype(np.int64), mark

    def _in_stash(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        held = set(map(tuple, self.stash.tolist()))
        if not held:
            return np.zeros(len(bucket), bool)
        other = self._other(bucket, mark)
        return np.array([(b, m) in held or (o, m) in held for b, o, m in zip(bucket.tolist(), other.tolist(), mark.tolist(), strict=True)], bool)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may have been taken; those that were always are."""
        bucket, mark = self._placed(keys)
        found = (self.slots[bucket] == mark[:, None]).any(1)
        found |= (self.slots[self._other(bucket, mark)] == mark[:, None]).any(1)
        return found | self._in_stash(bucket, mark)

    def _fill(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their bucket; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        turn = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
        taken = self.slots[b] != 0
        fits = turn < SLOTS - taken.sum(1)
        free = np.argsort(taken[fits], axis=1, kind="stable")
        self.slots[b[fits], free[np.arange(len(free)), turn[fits]]] = mark[order][fits]
        out = np.zeros(len(bucket), bool)
        out[order[fits]] = True
        return out

    def take(self, keys: np.ndarray) -> None:
        """Add one fingerprint for each key."""
        bucket, mark = self._placed(keys)
        for round_ in range(_ROUNDS):
            for _ in range(2):
                if not len(bucket):
                    return
                left = ~self._fill(bucket, mark)
                bucket, mark = bucket[left], mark[left]
                bucket = self._other(bucket, mark)
            # One of those that wait at each bucket goes in, and what it replaces waits elsewhere.
            _, one = np.unique(bucket, return_index=True)
            slot = (one + round_) % SLOTS
            out = self.slots[bucket[one], slot].astype(np.int64)
            self.slots[bucket[one], slot] = mark[one]
            mark[one] = out
            bucket[one] = self._other(bucket[one], out)
        self.stash = np.concatenate([self.stash, np.stack([bucket, mark], 1)])

    def forget(self, keys: np.ndarray) -> None:
        """Remove one fingerprint for each key; each must have been taken."""
        bucket, mark = self._placed(keys)
        for _ in range(2):
            waiting = True
            while waiting and len(bucket):
                hit = self.slots[bucket] == mark[:, None]
                slot = hit.argmax(1)
                found = np.flatnonzero(hit.any(1))
                _, one = np.unique(bucket[found] * SLOTS + slot[found], return_index=True)
                done = found[one]
                self.slots[bucket[done], slot[done]] = 0
                waiting = len(done) > 0
                bucket, mark = np.delete(bucket, done), np.delete(mark, done)
            bucket = self._other(bucket, mark)
        other = self._other(bucket, mark)
        stash = self.stash.tolist()
        for b, o, m in zip(bucket.tolist(), other.tolist(), mark.tolist(), strict=True):
            stash.remove([b, m] if [b, m] in stash else [o, m])
        self.stash = np.array(stash, np.int64).reshape(-1, 2)
