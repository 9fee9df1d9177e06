"""Ranked search against brute force, and its interval bounds."""

import math
import random
import re

import numpy as np
import odd_rows as odd
import pytest

from mediaweave.llm import postings, search

ITEMS = "item_id long, text string, doc_id string, rank string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=10):
    docs = [(i, words(t)) for i, t in docs]
    docs = [(i, w) for i, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        if text is None:
            continue
        found = []
        for i, w in docs:
            m = 10 + 90 * len(w) * n_docs // n_terms
            score = 0
            for t in set(words(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        found.sort()
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(found[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n long, terms string"),
        spark.createDataFrame([(i, t, "d", "r") for i, t in items], ITEMS),
    )


@pytest.mark.parametrize("postings_of_a_shard,block", [(50, 300), (1_000_000, 8_000_000)])
def test_against_brute_force(spark, postings_of_a_shard, block):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É1", "中", "Up", "up"]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 30, 64])]) for _ in range(rng.choice([1, 3, 20, 200])))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # copies: equal scores
    docs += [(7, docs[9][1]), (None, docs[9][1]), (None, None), (5, ""), (6, " ,.; ")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 10, 40])))) for k in range(25)]
    items += [(3, "w1 w2"), (3, "w1 w2"), (None, "w3,W4"), (30, None), (31, ""), (32, "unseen")]
    found = search.ranked(*tables(spark, docs, items), block_bytes=block, shard_postings=postings_of_a_shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in odd.rows()]
    items = [(1, odd.rows()[5][1]), (2, "中文 12 ½ É"), (None, "one")]
    found = search.ranked(odd.table(spark), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    nothing = tables(spark, [], [])
    assert search.ranked(nothing[0], items).collect() == []
    assert search.ranked(docs, nothing[1]).collect() == []
    assert got(search.ranked(docs, items)) == brute([(1, "a b")], [(1, "a")])


def test_only_intervals_that_may_win_are_split():
    # one rare term in a few documents, one common term in all: the rest is never looked at
    rng = np.random.default_rng(1)
    n = 4000
    lengths = rng.integers(50, 500, n)
    rare = np.zeros(n, bool)
    rare[rng.choice(n, 30, replace=False)] = True
    terms = [np.array([0, 1] if r else [0], np.int32) for r in rare]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    flat = np.concatenate(terms)
    shard = postings.Shard(
        lengths, starts, flat, np.ones(len(flat), np.int32), [[i] for i in range(n)], np.array([5, 9000]), n, int(lengths.sum())
    )
    asked = []
    highest = shard._highest
    shard._highest = lambda a, b: asked.append(len(a)) or highest(a, b)
    found = shard.search(np.array([0, 1]), 10, batch=4)
    assert len(found) == 10 and sum(asked) < 300
    m = 10 + 90 * lengths * n // int(lengths.sum())
    per = 1_000_000_000 // (1000 + 8 * m)
    want = sorted(zip((5 * per + np.where(rare, 9000 * per, 0)).tolist(), (-np.arange(n)).tolist()), reverse=True)[:10]
    assert found == [(s, -i) for s, i in want]
