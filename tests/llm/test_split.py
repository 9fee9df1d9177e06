"""Crowded regions split by the rarest shingles of their items: rows that grow with the members, and no lost link."""

import random

import numpy as np
from mediaweave.llm import linking, sketches


def test_crowded_regions_grow_with_their_members(spark, monkeypatch):
    """members that share a passage and no more are told apart without comparing all blocks, and no alike pair is lost."""
    rng = np.random.default_rng(7)
    common = rng.integers(0, 2**63, 8, dtype=np.uint64)
    made, torn = [], linking._torn

    def counted(rows, block):
        made.append(torn(rows, block).count())
        return torn(rows, block)

    monkeypatch.setattr(linking, "_torn", counted)
    for n in (250, 1250):
        sets = [np.concatenate((common, rng.integers(0, 2**63, rng.integers(3, 9), dtype=np.uint64))) for _ in range(n)]
        for k in range(40):  # near copies: of one shingle more, one less, and one other
            near, other = sets[5 * k], rng.integers(0, 2**63, 1, dtype=np.uint64)
            sets.append((np.concatenate((near, other)), near[:-1], np.concatenate((near[:-1], other)))[k % 3])
        sets = [np.sort(s) for s in sets]
        wanted = {(a, b) for b in range(n, n + 40) for a in range(b) if sketches.alike(sets[a], sets[b], 80)}
        assert len(wanted) >= 40
        looks = sketches.minhashes(sets, sketches.multipliers(64)).astype("u1")
        rows = [(i, len(s), looks[i].tobytes(), [4, 4], s.tobytes()) for i, s in enumerate(sets)]
        items = linking.stored(spark.createDataFrame(rows, "item long, size long, sketch binary, keys array<long>, set binary"), "items")
        regions = items.selectExpr("item", "posexplode(keys) AS (tree, key)").selectExpr("tree", "key", "item", "0L AS leader")
        nothing = spark.createDataFrame([], "item long, component long")
        links = linking._between(regions, items.drop("set"), items.select("item", "set"), nothing, 80, 16, (0,))
        assert all(sketches.alike(sets[r.a], sets[r.b], 80) for r in links.collect())
        named = {r.item: r.component for r in linking.components(links).collect()}
        assert all(named.get(a, a) == named.get(b, b) for a, b in wanted)
    assert made[1] < 6 * made[0]


def test_prefixes_of_alike_sets_meet():
    """Whatever the order of shingles, alike sets have one in common among their first ones."""
    rng = random.Random(8)
    met = 0
    for percent in (50, 80, 95):
        for _ in range(2000):
            a = set(rng.sample(range(40), rng.randrange(1, 30)))
            b = set(rng.sample(sorted(a), rng.randrange(len(a) // 2, len(a)) + 1)) | set(rng.sample(range(40, 50), rng.randrange(4)))
            if 100 * len(a & b) >= percent * len(a | b):
                order = rng.sample(range(50), 50)
                one, two = (sorted(s, key=order.index)[: linking.n_prefix(len(s), percent)] for s in (a, b))
                assert set(one) & set(two)
                met += 1
    assert met > 1000
    assert [linking.n_prefix(n, 80) for n in (1, 4, 5, 10, 16)] == [1, 1, 2, 3, 4]
