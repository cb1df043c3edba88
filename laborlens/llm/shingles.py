"""Words, hashes and shingles of texts inside tasks, on bytes and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, remembered while they fit."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words in turn; none where there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    h = np.full(n, U(k))
    for i in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return h


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct ``k``-word shingles, sorted; a text of fewer words is one shingle, a text without words none."""
    return np.unique(windows(hashes, min(k, len(hashes)))) if len(hashes) else hashes


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that working memory doesn't follow row counts."""
    for batch in batches:
        lengths = np.nan_to_num(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(lengths) // most).astype(int)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
