"""A cuckoo filter over pairs of 64-bit hashes, on numpy arrays: insertion, deletion and lookup of whole batches."""

from __future__ import annotations

import numpy as np

from laborlens.llm.shingles import U, mix

SLOTS, KICKS = 4, 400


class Cuckoo:
    """Each key has a 16-bit fingerprint in one of two buckets of four slots; 0 is a free slot."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(keys, 1) / SLOTS / 0.8)))), SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fingerprint = (k2.view(U) % U(65535) + U(1)).astype(np.uint16)
        return fingerprint, (mix(k1.view(U)) % U(len(self.table))).astype(np.int64)

    def _other(self, fingerprint: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fingerprint.astype(U)) % U(len(self.table))).astype(np.int64)

    def _settle(self, fingerprint: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts what fits into its bucket; which did."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        turn = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        fits = turn < free.sum(1)
        slot = np.argmax(np.cumsum(free[fits], 1) == turn[fits][:, None] + 1, 1)
        self.table[b[fits], slot] = fingerprint[order][fits]
        done = np.zeros(len(b), bool)
        done[order[fits]] = True
        return done

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Whether all keys found a place; if not, the filter must be rebuilt larger from the exact table."""
        fingerprint, bucket = self._places(k1, k2)
        left = ~self._settle(fingerprint, bucket)
        fingerprint, bucket = fingerprint[left], self._other(fingerprint, bucket)[left]
        for kick in range(KICKS):
            left = ~self._settle(fingerprint, bucket)
            fingerprint, bucket = fingerprint[left], bucket[left]
            if not len(bucket):
                return True
            # Of those that wait for a full bucket, one takes a slot and its former holder moves on.
            _, first = np.unique(bucket, return_index=True)
            b, slot = bucket[first], (mix(fingerprint[first].astype(U) + U(kick)) % U(SLOTS)).astype(np.int64)
            out = self.table[b, slot].copy()
            self.table[b, slot] = fingerprint[first]
            fingerprint[first], bucket[first] = out, self._other(out, b)
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fingerprint, bucket = self._places(k1, k2)
        f = fingerprint[:, None]
        return (self.table[bucket] == f).any(1) | (self.table[self._other(fingerprint, bucket)] == f).any(1)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out one copy of each key's fingerprint. Only keys that were inserted may be deleted."""
        fingerprint, bucket = self._places(k1, k2)
        left = np.arange(len(fingerprint))
        for at in (bucket, self._other(fingerprint, bucket)):
            todo, missed = left, [left[:0]]
            while len(todo):  # of keys that look alike in a bucket, one a turn
                _, first = np.unique(at[todo] * 65536 + fingerprint[todo], return_index=True)
                now, todo = todo[first], np.delete(todo, first)
                same = self.table[at[now]] == fingerprint[now][:, None]
                found = same.any(1)
                self.table[at[now[found]], same[found].argmax(1)] = 0
                missed.append(now[~found])
            left = np.concatenate(missed)
