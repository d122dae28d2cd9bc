"""Words of a batch of texts and the character n-grams of its distinct words, as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


class Batch:
    """distinct: the words; which: of each word in turn, its place in ``distinct``; starts: of each text, its
    first word; counts: the words of each text."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        words: list[bytes] = []
        counts = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            own = (raw.lower() if lower else raw).split()
            words += own
            counts.append(len(own))
        self.counts = np.array(counts, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))[:-1].astype(np.int64)
        which, distinct = pd.factorize(np.array(words, dtype=object))
        self.which, self.distinct = which.astype(np.int64), list(distinct)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of per-word ``values`` over each text."""
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[self.starts + self.counts] - total[self.starts]


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with one space around and between them, which is a space, and the word at each place
    (a space: the word after it)."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = raw == 32
    return raw, space, np.cumsum(space) - 1


def ngrams(raw: np.ndarray, space: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the byte n-grams inside words, their boundaries included."""
    size = len(raw) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = np.ones(size, bool)
    for k in range(1, n - 1):
        good &= ~space[k : k + size]
    at = np.flatnonzero(good)
    code = np.full(len(at), n, np.uint64)
    for k in range(n):
        code = (code ^ raw[at + k].astype(np.uint64)) * MIX[k % 4]
        code ^= code >> np.uint64(29)
    return at, code


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
