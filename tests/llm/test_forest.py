"""The LSH forest: labels, neighbours in sorted order over partitions, crowded regions, and recall by brute force."""

import random
from itertools import combinations

import numpy as np
from mediaweave.llm import forest, linking, neardup

DEPTH, TREES = 3, 4


def steps(a, b):
    return sum(int(a) >> s == int(b) >> s for s in forest.SHIFTS)


def test_labels_share_the_steps_of_their_paths():
    rng = np.random.default_rng(3)
    width = DEPTH + forest.DEEPER
    hashes = rng.integers(0, 2**32, (2, TREES * width), dtype=np.uint64).astype(np.uint32)
    for equal in range(width + 1):
        hashes[1] = rng.integers(0, 2**32, TREES * width, dtype=np.uint64)
        for t in range(TREES):
            hashes[1, t * width : t * width + equal] = hashes[0, t * width : t * width + equal]
        one, two = forest.labels(hashes, DEPTH)
        assert [steps(a, b) for a, b in zip(one, two)] == [max(0, equal - DEPTH + 1)] * TREES


def test_neighbours_over_partitions(spark):
    """Regions and neighbours are those of one sorted list, however the rows are dealt; one label is very common."""
    rng = random.Random(4)
    base = [rng.randrange(-(2**39), 2**39) for _ in range(12)]

    def label():
        if rng.random() < 0.3:
            return (base[0] << forest.SHIFTS[0]) + 5
        return (rng.choice(base) << forest.SHIFTS[0]) + (rng.randrange(3) << 12) + rng.randrange(3)

    rows = [(i, [label() for _ in range(TREES)]) for i in range(300)] + [(1000 + i, [2**60 + i * 2**30 + t for t in range(TREES)]) for i in range(9)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        regions, nearest = forest.regions_and_neighbours(spark.createDataFrame(rows, "item long, keys array<long>"))
        got = {(r.tree, r.key, r.item) for r in regions.collect()}
        pairs = {r.a: r.b for r in nearest.collect()}
        leaders = regions.selectExpr("tree", f"shiftright(key, {forest.SHIFTS[0]}) AS k", "leader").distinct().groupBy("tree", "k").count()
        assert leaders.filter("count > 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want, best = set(), {}
    for t in range(TREES):
        order = sorted((keys[t], i) for i, keys in rows)
        for (k, a), (m, b) in zip(order, order[1:]):
            if n := steps(k, m):
                want |= {(t, k, a), (t, m, b)}
                best[a], best[b] = max(best.get(a, (0, 0)), (n, b)), max(best.get(b, (0, 0)), (n, a))
    assert got == want
    assert pairs == {a: b for a, (_, b) in best.items()}


def test_only_regions_crowded_with_unlike_items_go_deeper(spark):
    top, mid, low = forest.SHIFTS
    rows = [(0, (7 << top) + (i % 4 << mid), i) for i in range(40)]  # unlike: cut once, into four of ten
    rows += [(1, (8 << top) + (i % 4 << mid), 100 + i) for i in range(40)]  # one component: stays whole
    rows += [(2, (9 << top) + 5, 200 + i) for i in range(40)]  # unlike with one label: cut twice, and still together
    regions = spark.createDataFrame([(*r, 0) for r in rows], "tree int, key long, item long, leader long")
    found = spark.createDataFrame([(100 + i, 100) for i in range(40)], "item long, component long")
    got, _ = linking._at_depth(regions, found, 16, forest.SHIFTS)
    bits = {0: mid, 1: top, 2: low}
    assert {(r.tree, r.key, r.item) for r in got.collect()} == {(t, k >> bits[t], i) for t, k, i in rows}


def share(a, b):
    return len(a & b) / len(a | b)


def test_crowded_region_of_unlike_documents(spark):
    """Documents that share a long notice, in regions far above the block size, with pairs at 0.80 to 0.85 hidden among them."""
    rng = random.Random(6)
    notice = [f"n{i}" for i in range(40)]
    texts = []
    for _ in range(420):
        texts.append(notice + [f"w{rng.randrange(10**6)}" for _ in range(30)])
    for at in range(0, 160, 2):  # 69 shingles, of which 7 change: 62 / 76 = 0.816
        near = list(texts[at])
        near[-7:] = [f"z{rng.randrange(10**6)}" for _ in range(7)]
        texts[at + 1] = near
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(zip(t, t[1:])) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if share(sets[a], sets[b]) >= 0.8]
    assert len(near) == 80 and all(share(sets[a], sets[b]) < 0.85 for a, b in near)
    of = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2, block=16).collect()}
    found = sum(of[a] == of[b] for a, b in near)
    assert found >= 0.99 * len(near)
    assert all(of[i] == i for i in range(160, 420))
    # the same without any cut
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()} == of
