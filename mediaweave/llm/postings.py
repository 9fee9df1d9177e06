"""Posting lists of a bounded shard of documents, and exact top-k search over document intervals; runs inside tasks.

Documents of a shard are numbered by length.  The postings of all terms lie in one array, by term and number, and a
sparse table over it names the posting of the highest impact in any stretch of a list.  For a query, an interval of
documents is bounded by the sum of its terms' highest impacts in it.  The interval of the highest bound is taken first
(a batch of them at a time), split at the document that holds its highest impact, which is scored in full, and both
halves wait with bounds of their own until no bound reaches the k-th score.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Intervals that are split at a time.
BATCH = 64


class Shard:
    """``lengths``: terms of each document; ``starts``: where its (terms, tfs) begin, one more entry at the end; ``weights`` by
    term.  ``ids``: sorted doc_ids of each document, as equal documents are one."""

    def __init__(self, lengths, starts, terms, tfs, ids, weights, n_docs: int, n_terms: int):
        order = np.argsort(lengths, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ids = [ids[i] for i in order.tolist()]
        self.docs = len(order)
        doc = np.repeat(number, np.diff(starts))
        useful = weights[terms] > 0
        doc, terms, tfs = doc[useful], terms[useful].astype(np.int64), tfs[useful].astype(np.int64)
        # 64-bit products hold up to some 10^17 for n * N; beyond, Python's whole numbers are taken
        m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)[order]
        key = terms * (self.docs + 1) + doc
        by = np.argsort(key, kind="stable")
        self.key, self.doc = key[by], doc[by].astype(np.int32)
        tfs = tfs[by]
        self.impact = weights[terms[by]] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[self.doc]))
        self.tables = self._sparse_table(terms[by])

    def _sparse_table(self, terms: np.ndarray) -> list[np.ndarray]:
        """tables[j][i]: the posting of the highest impact among the 2^j from i on (of no meaning across the end of a list)."""
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        out = [np.arange(len(terms), dtype=np.int32)]
        while 2 << (len(out) - 1) <= longest:
            half = 1 << (len(out) - 1)
            a, b = out[-1][:-half], out[-1][half:]
            out.append(np.where(self.impact[a] >= self.impact[b], a, b))
        return out

    def _highest(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting of the highest impact in [left, right) and the impact, 0 where the stretch is empty."""
        width = right - left
        level = np.frexp(np.maximum(width, 1))[1] - 1
        best = np.zeros(left.shape, np.int64)
        value = np.zeros(left.shape, np.int64)
        for j in np.unique(level[width > 0]).tolist():
            at = np.nonzero((level == j) & (width > 0))
            a = self.tables[j][left[at]]
            b = self.tables[j][right[at] - (1 << j)]
            x, y = self.impact[a], self.impact[b]
            best[at] = np.where(x >= y, a, b)
            value[at] = np.maximum(x, y)
        return best, value

    def search(self, terms: np.ndarray, top: int, batch: int = BATCH) -> list[tuple[int, int | None]]:
        """(score, doc_id) of the ``top`` documents, equal scores by doc_id."""
        base = terms.astype(np.int64) * (self.docs + 1)
        left, right = np.searchsorted(self.key, base), np.searchsorted(self.key, base + self.docs)
        there = left < right
        base, left, right = base[there], left[there][None, :], right[there][None, :]
        if not base.size:
            return []
        best, value = self._highest(left, right)
        bound = value.sum(axis=1)
        found: list[tuple] = []  # the worst of the best comes first
        least = 1
        while len(bound):
            if len(bound) > batch:
                chosen = np.argpartition(bound, len(bound) - batch)[-batch:]
            else:
                chosen = np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            l, r = left[chosen], right[chosen]
            winner = value[chosen].argmax(axis=1)
            split = self.doc[best[chosen, winner]].astype(np.int64)
            # several intervals never hold the same document
            at = np.searchsorted(self.key, base[None, :] + split[:, None])
            inside = np.minimum(at, len(self.key) - 1)
            holds = (at < r) & (self.key[inside] == base[None, :] + split[:, None])
            scores = np.where(holds, self.impact[inside], 0).sum(axis=1)
            for score, number in zip(scores.tolist(), split.tolist()):
                if score >= least:
                    for i in self.ids[number][:top]:
                        # a missing id ranks last among equals
                        entry = (score, i is not None, -(i or 0))
                        if len(found) < top:
                            heapq.heappush(found, entry)
                        elif entry > found[0]:
                            heapq.heapreplace(found, entry)
                    if len(found) == top:
                        least = found[0][0]
            new_left = np.concatenate((l, np.where(holds, at + 1, at)))
            new_right = np.concatenate((at, r))
            new_best, new_value = self._highest(new_left, new_right)
            new_bound = new_value.sum(axis=1)
            keep, open_ = new_bound >= least, rest & (bound >= least)
            left, right = np.concatenate((left[open_], new_left[keep])), np.concatenate((right[open_], new_right[keep]))
            best, value = np.concatenate((best[open_], new_best[keep])), np.concatenate((value[open_], new_value[keep]))
            bound = np.concatenate((bound[open_], new_bound[keep]))
        return [(s, -i if known else None) for s, known, i in sorted(found, reverse=True)]
