"""Sparse suffixes of word sequences in numpy; runs inside tasks."""

from __future__ import annotations

import numpy as np

from mediaweave.llm import sketches

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)


class Powers:
    """Powers of an odd base, and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            size = max(1 << 16, 2 * n)
            for name, base in (("up", _P), ("down", _INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))


class Sequence:
    """Words of a text as hashes, with the hash of any stretch of them."""

    def __init__(self, words: np.ndarray, powers: Powers):
        n = len(words)
        powers.reach(n + 1)
        self.n, self.powers = n, powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers.up[:n], out=self.sums[1:])

    def stretch(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        x = (self.sums[past] - self.sums[first]) * self.powers.down[first]
        return sketches.mixed(x + (past - first).astype(np.uint64))


def _window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    best, at = x, np.arange(len(x))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        have += step
    return at[:n]


def anchors(seq: Sequence, span: int, gram: int, reach: int):
    """The minimiser of every ``span``-word window: (place, first window, last window) of each, in order.

    The anchor of a window is the least ``gram``-word hash among its first ``reach`` places, so equal windows
    have equal anchors at equal offsets.
    """
    n = seq.n - span + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    places = np.arange(n + reach - 1)
    at = _window_argmin(seq.stretch(places, places + gram), reach)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return at[first], first, last
