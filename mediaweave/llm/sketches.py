"""Shingle sets, their minhashes and comparisons in numpy; runs inside tasks."""

from __future__ import annotations

import math

import numpy as np
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence is one."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    x = mixed(words[: n - width + 1] + np.uint64(width))
    for j in range(1, width):
        x = mixed(x * _A + words[j : n - width + 1 + j])
    return np.unique(x)


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhashes(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Minhash matrix, a row per set; a set must not be empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), len(factors)), np.uint32)
    for i, a in enumerate(factors):
        h = x * a
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def flat_minhashes(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The same for sets that stand end to end in one array."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(factors)), np.uint32)
    for i, a in enumerate(factors):
        h = x * a
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set, as signed numbers."""
    one = np.add.reduce(mixed(s + _A), dtype=np.uint64) if len(s) else np.uint64(0)
    two = np.bitwise_xor.reduce(mixed(s * _A + _B)) if len(s) else np.uint64(0)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def path_keys(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Per row the 64-bit name of each tree's region: ``depth`` consecutive minhashes."""
    n, total = hashes.shape
    trees = total // depth
    parts = hashes[:, : trees * depth].reshape(n, trees, depth).astype(np.uint64)
    x = np.zeros((n, trees), np.uint64) + np.arange(trees, dtype=np.uint64)
    for j in range(depth):
        x = mixed(x * _A + parts[:, :, j] + np.uint64(1))
    return x.view(np.int64)


def batches_of(texts, k: int, memo: WordHashes, limit: int = 1 << 18):
    """(first row, shingle sets) of consecutive texts of a binary Arrow array, about ``limit`` words at a time."""
    held, words, first = [], 0, 0
    for i, text in enumerate(texts):
        found = memo.of((text.as_py() or b"").lower().split())
        held.append(shingles(found, k))
        words += len(found)
        if words >= limit:
            yield first, held
            held, words, first = [], 0, i + 1
    if held:
        yield first, held


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets share at least ``percent`` of their union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * 100 >= percent * (len(a) + len(b) - shared)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard of rows of ``a`` with rows of ``b`` from one byte per minhash."""
    equal = np.count_nonzero(a == b, axis=-1) / a.shape[-1]
    return (equal * 256 - 1) / 255


def floor_of(percent: int, hashes: int) -> float:
    """Estimates below this rule the similarity out, five standard deviations away."""
    j = percent / 100
    return j - 5 * math.sqrt(j * (1 - j) / hashes)
