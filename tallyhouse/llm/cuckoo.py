"""Cuckoo filter over 128-bit keys: insert, delete and batched lookup."""

from __future__ import annotations

import numpy as np

from .kernels import mix

SLOTS, KICKS = 4, 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; never forgets a key it holds.

    Keys come as two int64 columns. A key's buckets are ``i`` and
    ``i ^ mix(fingerprint)``. A full filter grows to twice the buckets, from
    the keys that its owner holds; ``insert`` then returns False.
    """

    def __init__(self, capacity: int):
        buckets = 1 << max(1, int(capacity / SLOTS / 0.85)).bit_length()
        self.cells = np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def build(hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        capacity = max(1, len(hi))
        while True:
            out = CuckooFilter(capacity)
            if all(out.insert(a, b) for a, b in zip(hi.tolist(), lo.tolist())):
                return out
            capacity *= 2

    def _place(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.cells) - 1)
        mark = (hi.astype(np.int64).view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = mix(lo.astype(np.int64).view(np.uint64)) & mask
        return mark, first.astype(np.int64), ((first ^ mix(mark.astype(np.uint64))) & mask).astype(np.int64)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ int(mix(np.array([mark], np.uint64))[0]) & (len(self.cells) - 1)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._place(np.asarray(hi), np.asarray(lo))
        return ((self.cells[a] == mark[:, None]) | (self.cells[b] == mark[:, None])).any(axis=1)

    def insert(self, hi: int, lo: int) -> bool:
        mark, a, b = (int(x[0]) for x in self._place(np.array([hi]), np.array([lo])))
        bucket = a
        for bucket in (a, b):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        """Take one key out; it must be in the filter."""
        mark, a, b = (int(x[0]) for x in self._place(np.array([hi]), np.array([lo])))
        for bucket in (a, b):
            at = np.flatnonzero(self.cells[bucket] == mark)
            if len(at):
                self.cells[bucket, at[0]] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> CuckooFilter:
        out = CuckooFilter.__new__(CuckooFilter)
        out.cells = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return out
