"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds most words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the text's shingles in order, A-Z lower-cased; fewer than five words are one shingle, none are none."""
    words = data.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    if len(h) < WORDS:
        return mixed((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = h[:n] * _ODD[0]
    for k in range(1, WORDS):
        total += h[k : k + n] * _ODD[k]
    return mixed(total)


def shingle_set(data: bytes, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(data, hashes))


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, count long, one range after the other."""
    return np.arange(counts.sum()) + np.repeat(begins - np.cumsum(counts) + counts, counts)


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The sets of many texts end to end, each sorted, and where each begins (one place more than texts)."""
    words = [x.lower().split() for x in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    begins = np.cumsum(n) - n
    total = np.zeros(len(h), np.uint64)
    if (last := len(h) - WORDS + 1) > 0:
        for k in range(WORDS):
            total[:last] += h[k : k + last] * _ODD[k]
    for i in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
        total[begins[i]] = (h[begins[i] : begins[i] + n[i]] * _ODD[: n[i]]).sum() + np.uint64(n[i])
    counts = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    items = mixed(total[ranges(begins, counts)])
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        items[a:b].sort()
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    new[(ends - counts)[counts > 0]] = True
    bounds = np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])]
    return items[new], bounds
