"""Word-level suffix automaton of a bounded set of items; runs inside tasks."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

#: Lower-cases A-Z and blanks every other ASCII character that is no digit or letter, byte by byte.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of all items.

    ``window`` words of an item in a row are a window; an item of fewer words is one window itself.
    Every state knows the items that have a window ending there.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = 10):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        self.items: dict[tuple[int, int], set[str | None]] = {}
        for name, word_ids in coded:
            size = min(window, len(word_ids))
            state = 0
            for n, c in enumerate(word_ids, 1):
                state = self.next[state][c]
                if n >= size:
                    self.items.setdefault((self._holding(state, size), size), set()).add(name)
        self.sizes = sorted({size for _, size in self.items})
        pairs = {a * len(self.ids) + b for _, w in coded for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # a further item that begins like an earlier one
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _holding(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what ``state`` has matched."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def runs(self, docs: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """Per document the stretches, long enough for a window, whose neighbouring words are neighbours in an item.

        A longest match of two words or more never leaves such a stretch, so the automaton needs to see nothing else.
        """
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # one gap after each document
        ids = np.full(int(starts[-1]), -1, np.int64)
        get = self.ids.get
        for at, words in zip(starts, docs):
            ids[at : at + len(words)] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        joined = np.zeros(len(ids), bool)  # word i and word i+1
        both = np.flatnonzero(known[:-1] & known[1:])
        code = ids[both] * len(self.ids) + ids[both + 1]
        if len(self.pairs):
            found = np.searchsorted(self.pairs, code)
            found[found == len(self.pairs)] = 0
            joined[both[self.pairs[found] == code]] = True
        first = np.flatnonzero(known & ~np.concatenate(([False], joined[:-1])))
        last = np.flatnonzero(known & ~joined)
        long = last - first + 1 >= self.sizes[0]
        out: list[list[tuple[int, int]]] = [[] for _ in docs]
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            d = int(np.searchsorted(starts, a, "right")) - 1
            out[d].append((a - int(starts[d]), b + 1 - int(starts[d])))
        return out

    def hits(self, words: list[bytes], runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged spans of hit words, items with occurring windows, and the longest match."""
        spans: list[list[int]] = []
        items: set = set()
        longest = 0
        for a, b in runs:
            state = matched = 0
            for at in range(a, b):
                c = self.ids[words[at]]
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    matched += 1
                longest = max(longest, matched)
                reach = 0
                for size in self.sizes:
                    if size > matched:
                        break
                    if found := self.items.get((self._holding(state, size), size)):
                        items |= found
                        reach = size
                if reach:
                    start = at + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at + 1])
        return [(a, b) for a, b in spans], items, longest

    def scan(self, docs: list[list[bytes]]):
        if not self.sizes:
            return [([], set(), 0) for _ in docs]
        return [self.hits(words, runs) if runs else ([], set(), 0) for words, runs in zip(docs, self.runs(docs))]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(NORMAL))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, text[done:]])


def without_hits(text: bytes, automaton: Automaton) -> bytes:
    """Remove hit spans until no window is left; a removal may bring new neighbours together."""
    while True:
        spans = automaton.scan([normal_words(text)])[0][0]
        if not spans:
            return text
        text = cut(text, spans)
