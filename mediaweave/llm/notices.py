"""Template windows and their MinHash bands in numpy; runs inside tasks."""

from __future__ import annotations

from bisect import bisect

import numpy as np

from mediaweave.llm import matching, sketches

#: containment, place (negated, so that the earliest of equals is the greatest), past word
_Hit = tuple[float, int, int]


def window_places(n: int, window: int) -> list[tuple[int, int]]:
    """Overlapping windows, half a window apart, that cover ``n`` words; one if there are no more than a window."""
    if n <= window:
        return [(0, n)]
    starts = list(range(0, n - window, window // 2)) + [n - window]
    return [(s, s + window) for s in starts]


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, in place."""
    x = sketches.mixed(words[: len(words) - k + 1])
    for j in range(1, k):
        x = sketches.mixed(x * sketches._A + words[j : len(words) - k + 1 + j])
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, best = 1, x
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return best


class Templates:
    """Windows of (license, words): their shingles and, per window length, a band table of minhashes."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], window: int, shingle: int, n_bands: int):
        self.window = window
        self.shingle = shingle
        self.names = [name for name, _ in templates]
        self.n_windows = [0] * len(templates)
        self.factors = sketches.multipliers(n_bands, seed=9).astype(np.uint64) | np.uint64(1 << 33)
        self.memo = sketches.WordHashes()
        self.windows: list[tuple[int, np.ndarray]] = []
        #: where each window begins in its template, and the words of each template
        self.offsets: list[int] = []
        self.lengths = [len(words) for _, words in templates]
        self.bands: dict[int, list[dict[int, list[int]]]] = {}
        every = []
        for t, (_, words) in enumerate(templates):
            if not words:
                continue
            hashes = self.memo.of(words)
            for first, past in window_places(len(words), window):
                grams = np.unique(runs_of(hashes[first:past], min(shingle, past - first)))
                size = past - first
                tables = self.bands.setdefault(size, [{} for _ in self.factors])
                for table, least in zip(tables, self.hashed(grams).min(axis=1).tolist()):
                    table.setdefault(least, []).append(len(self.windows))
                self.windows.append((t, grams))
                self.offsets.append(first)
                self.n_windows[t] += 1
                every.append((min(shingle, size), grams))
        self.known = {
            k: np.unique(np.concatenate([g for w, g in every if w == k])) for k in sorted({w for w, _ in every})
        }

    def hashed(self, grams: np.ndarray) -> np.ndarray:
        return sketches.mixed(grams[None, :] * self.factors[:, None])

    def find(self, text: bytes | None, percent: int) -> list[tuple[int, int, float, int, int]]:
        """(template, windows found, best containment, first word, past word) of the templates in a text, once for
        every occurrence; a text shorter than a window is one window of its own length."""
        words = matching.normal_words(text)
        hashes = self.memo.of(words)
        runs = {k: runs_of(hashes, k) for k in self.known if len(words) >= k}
        # a window that shares no shingle with any template can neither collide nor contain
        hit = {k: _held(x, self.known[k]) for k, x in runs.items()}
        found: dict[int, dict[int, list[_Hit]]] = {}
        for size, tables in self.bands.items():
            k = min(self.shingle, size)
            if k not in hit or not len(hit[k]):
                continue
            width = min(size, len(words))
            for first, past in _around(hit[k], width, len(words)):
                grams = runs[k][first : past - k + 1]
                tried: set[tuple[int, int]] = set()
                for table, values in zip(tables, self.hashed(grams)):
                    least = sliding_min(values, width - k + 1)
                    for at in np.flatnonzero(np.isin(least, np.fromiter(table, np.uint64, len(table)))).tolist():
                        tried.update((w, at) for w in table[int(least[at])])
                for w, at in tried:
                    t, wanted = self.windows[w]
                    held = np.isin(wanted, grams[at : at + width - k + 1]).sum()
                    if held * 100 >= len(wanted) * percent:
                        place = first + at
                        found.setdefault(t, {}).setdefault(w, []).append((held / len(wanted), -place, place + width))
        return [
            (t, len(o), float(max(x[0] for x in o.values())), min(-x[1] for x in o.values()), max(x[2] for x in o.values()))
            for t, hits in sorted(found.items())
            for o in self._occurrences(t, hits, percent)
        ]

    def _occurrences(self, t: int, hits: dict[int, list[_Hit]], percent: int) -> list[dict[int, _Hit]]:
        """The windows of each occurrence of a template, in order of place, if they are half of all or more.

        Hits that would put the template's begin at about the same word belong together; neighbouring parts without a
        common window are one occurrence into which words were inserted.  If only all hits of the text together
        hold half of the windows, the best of each window are taken as one occurrence."""
        placed = sorted((-x[1] - self.offsets[w], w, x) for w, found in hits.items() for x in _apart(found, percent))
        parts: list[tuple[int, int, dict[int, _Hit]]] = []
        for start, w, x in placed:
            if parts and start - parts[-1][1] <= self.window // 2 and w not in parts[-1][2]:
                parts[-1] = (parts[-1][0], start, parts[-1][2] | {w: x})
            else:
                parts.append((start, start, {w: x}))
        out: list[tuple[int, dict[int, _Hit]]] = []
        for first, last, part in parts:
            if out and first - out[-1][0] <= self.lengths[t] and not out[-1][1].keys() & part.keys():
                out[-1] = (last, out[-1][1] | part)
            else:
                out.append((last, part))
        whole = [o for _, o in out if 2 * len(o) >= self.n_windows[t]]
        if not whole and 2 * len(hits) >= self.n_windows[t]:
            whole = [{w: max(found) for w, found in hits.items()}]
        return whole


def _apart(found: list[_Hit], percent: int) -> list[_Hit]:
    """The best hits of a window that are too far apart to be the same words."""
    kept: list[_Hit] = []
    places: list[int] = []
    for x in sorted(found, reverse=True):
        at = bisect(places, -x[1])
        near = max(1, (x[2] + x[1]) * percent // 100)
        if all(abs(p + x[1]) >= near for p in places[max(0, at - 1) : at + 1]):
            places.insert(at, -x[1])
            kept.append(x)
    return kept


def _held(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the values that are known (sorted)."""
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return np.flatnonzero(known[at] == x)


def _around(places: np.ndarray, size: int, n: int) -> list[tuple[int, int]]:
    """Stretches of words that hold every window of ``size`` words with one of the places."""
    out: list[list[int]] = []
    for p in places.tolist():
        first, past = max(0, p - size + 1), min(n, p + size)
        if past - first < size:
            first, past = max(0, past - size), min(n, first + size)
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return [(a, b) for a, b in out if b - a >= size]
