"""Cross-parsing texts against suffix automata of labelled samples; runs inside tasks."""

from __future__ import annotations

import re

import numpy as np

_GAP = re.compile(r"[\W\d_]+")
#: Bytes that are parsed on their own: a phrase ends where a stretch ends, in every language alike.
STRETCH = 512


def letters(text: str | None) -> bytes:
    """Lower-case words of a text with single blanks between, as UTF-8; empty if it has no letter."""
    words = _GAP.sub(" ", text.lower()).strip() if text else ""
    return words.encode() if any(map(str.isalpha, words)) else b""


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
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
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Languages:
    """Dense transition tables of one automaton per language.

    An entry leads to the state after a byte and tells, in its lowest bit, whether a new phrase began:
    the longest match ended, so the byte starts the next one.  Parsing is a table look-up per byte.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        used = sorted({c for s in samples.values() for c in s})
        self.width = len(used) + 1  # the last symbol stands for every unseen byte
        self.symbol = np.full(256, len(used), np.uint8)
        self.symbol[used] = np.arange(len(used), dtype=np.uint8)
        tables, self.roots, at = [], [], 0
        for name in self.names:
            nxt = automaton(samples[name])
            first = np.full(self.width, at * 2 + 1, np.int64)
            for c, state in nxt[0].items():
                first[self.symbol[c]] = (at + state * self.width) * 2 + 1
            table = np.tile(first, (len(nxt), 1))
            for state, to in enumerate(nxt[1:], 1):
                for c, target in to.items():
                    table[state, self.symbol[c]] = (at + target * self.width) * 2
            tables.append(table.ravel())
            self.roots.append(at)
            at += table.size
        kind = np.int32 if 2 * at < 2**31 else np.int64
        self.table = np.concatenate(tables).astype(kind) if tables else np.zeros(0, kind)
        #: bits to name a place of the sample: what a phrase costs
        self.cost = np.array([np.log2(len(samples[n]) + 1) for n in self.names])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases per text and language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        counts = np.zeros((len(self.names), len(owner)), np.int32)
        lanes = max(1, 16_384 // max(1, len(self.names)))
        for a in range(0, len(owner), lanes):
            at, size = start[a : a + lanes], length[a : a + lanes]
            state = np.repeat(np.array(self.roots, self.table.dtype)[:, None], len(at), axis=1)
            seen = np.zeros(state.shape, np.int32)
            active = len(at)
            for j in range(int(size[0])):
                while size[active - 1] <= j:
                    active -= 1
                step = self.table[state[:, :active] + symbols[at[:active] + j]]
                seen[:, :active] += step & 1
                state[:, :active] = step >> 1
            counts[:, a : a + lanes] = seen
        out = np.zeros((len(texts), len(self.names)), np.int64)
        np.add.at(out, owner, counts.T)
        return out

    def predict(self, texts: list[str | None], batch: int = 1 << 20) -> list[tuple[str, float]]:
        """Label and score per text: the language of the fewest bits; score is its margin over the next."""
        out: list[tuple[str, float]] = []
        held: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(letters(text))
            size += len(held[-1])
            if size >= batch or i == len(texts) - 1:
                out += self._labels(held)
                held, size = [], 0
        return out

    def _labels(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.names:
            return [("und", 0.0)] * len(texts)
        bits = self.phrases(texts) * self.cost
        best = bits.argmin(axis=1)
        ranked = np.sort(bits, axis=1)
        least, second = ranked[:, 0], ranked[:, min(1, len(self.names) - 1)]
        margin = 1 - least / np.maximum(second, 1e-9) if len(self.names) > 1 else np.ones(len(texts))
        return [(self.names[b], float(m)) if t else ("und", 0.0) for t, b, m in zip(texts, best, margin)]
