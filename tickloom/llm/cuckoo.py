"""A cuckoo filter over numpy arrays: approximate membership with deletion, never a false negative."""

from __future__ import annotations

import numpy as np

from .kernels import U64, mix64

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's second bucket is its first, xor a hash of its fingerprint.

    Keys are 64-bit hashes and go in and out in batches. A batch that finds no room doubles nothing: the caller sizes
    the filter (`for_keys`), and what can't be placed after many rounds is kept in a small exact stash.
    """

    def __init__(self, n_buckets: int):
        self.n = 1 << max(0, (n_buckets - 1).bit_length())
        self.table = np.zeros((self.n, SLOTS), np.uint16)
        self.stash: dict[int, int] = {}

    @classmethod
    def for_keys(cls, keys: int) -> CuckooFilter:
        return cls(max(1, -(-keys // 3)))  # three of four slots in use at most

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(np.asarray(keys, U64) + U64(0x51_7C_C1_B7_27_22_0A_95))
        mark = ((h >> U64(48)) % U64(0xFFFF) + U64(1)).astype(np.uint16)
        first = (h & U64(self.n - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(U64)) & U64(self.n - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Each key once more; a key inserted twice must be deleted twice."""
        mark, bucket, _ = self._places(keys)
        rng = np.random.default_rng(0)
        for turn in range(500):
            if not len(mark):
                return
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)  # among the batch's keys for this bucket
            free = self.table[bucket] == 0
            room = free.sum(1)
            fits = rank < room
            slot = (np.cumsum(free, 1) == (rank + 1)[:, None]).argmax(1)
            self.table[bucket[fits], slot[fits]] = mark[fits]
            mark, bucket, rank = mark[~fits], bucket[~fits], rank[~fits]
            if turn and len(mark):  # swap with a random slot; one key for each bucket at a time
                lead = np.append(True, bucket[1:] != bucket[:-1])
                put = rng.integers(SLOTS, size=int(lead.sum()))
                out = self.table[bucket[lead], put].copy()
                self.table[bucket[lead], put] = mark[lead]
                mark[lead] = out
            bucket = self._other(bucket, mark)
        for m, b in zip(mark.tolist(), bucket.tolist(), strict=True):
            place = min(b, int(self._other(np.array([b]), np.array([m], np.uint16))[0])) << 16 | m
            self.stash[place] = self.stash.get(place, 0) + 1

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        if self.stash:
            found |= np.fromiter((int(min(x, y)) << 16 | int(m) in self.stash for x, y, m in zip(a, b, mark, strict=True)), bool, len(mark))
        return found

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted; one fingerprint each."""
        for m, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            place = min(a, b) << 16 | m
            if self.stash.get(place):
                self.stash[place] -= 1
                if not self.stash[place]:
                    del self.stash[place]
                continue
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        stash = np.array([[k, v] for k, v in self.stash.items()], np.int64).reshape(-1, 2)
        return np.int64(self.n).tobytes() + self.table.tobytes() + stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        out = cls(n)
        end = 8 + n * SLOTS * 2
        out.table = np.frombuffer(data[8:end], np.uint16).reshape(n, SLOTS).copy()
        out.stash = {int(k): int(v) for k, v in np.frombuffer(data[end:], np.int64).reshape(-1, 2)}
        return out
