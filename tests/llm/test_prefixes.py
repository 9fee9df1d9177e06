"""The conversation trie and its roll-up against brute force."""

import hashlib
import random
import zlib

import pytest

from mediaweave.llm import centroids, prefixes

KIND = "conv_id long, turn long, role string, text string, depth string, k1 string, chain string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", "c") for r in rows], KIND)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = own.get(lead, [])[:h] + mine[h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        up = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(k), up, len(m), len(kids.get(k, [])), leaves[k], saved[k], digest))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_columns(spark):
    out = prefixes.prefix_trie(table(spark, [(1, 1, "u", "x")]))
    assert out.dtypes == [
        ("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"),
        ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string"),
    ]


@pytest.mark.parametrize("limit", [1, 3, 40, 1 << 16])
def test_against_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = []
    for c in range(-12, 40):
        n = rng.choice([0, 1, 2, 9, 12, 30])
        # few texts, so that conversations share more than the rebuilding gives them
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["é", "aa", "b", ""])) for t in range(n)]
    rows += [(100 + i, t, "user", f"long {t}") for i in range(7) for t in range(60 + 3 * (i % 3))]  # deep copies
    assert got(prefixes.prefix_trie(table(spark, rows), limit=limit, slice_rows=16)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "x"),
        (5, None, None, None), (5, None, "u", ""), (5, 0, "u", "x" * 100_000), (5, 0, "u", "x" * 100_000),
        (6, 3, "u", "b"), (6, 3, "u", "a"), (6, -1, None, "é"),
        (9, 1, "u", "alone"),  # nothing of it may be left
        (-7, 1, "u", "x"), (-5, 1, "u", "x"),
    ]
    assert got(prefixes.prefix_trie(table(spark, rows))) == brute(rows)
    assert prefixes.prefix_trie(table(spark, [])).collect() == []
    assert prefixes.prefix_trie(table(spark, [(None, 1, "u", "x")])).collect() == []


def test_turnless_conversation(spark):
    # a conversation with fewer turns than it would share of an absent one
    short = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(short, 1, "u", "x")]
    assert got(prefixes.prefix_trie(table(spark, rows))) == brute(rows)
    assert brute(rows)[0][1:4] == (0, None, 1)


def test_large_groups_of_ends(spark):
    rows = [(c, i) for c in (1, 2) for i in range(1, 10_001 if c == 1 else 5)]
    found = prefixes.id_digests(spark.createDataFrame(rows, "k long, conv_id long").repartition(5), ["k"], piece=64)
    want = {c: hashlib.sha256(",".join(str(i) for k, i in rows if k == c).encode()).hexdigest() for c in (1, 2)}
    assert {r.k: r.digest for r in found.collect()} == want


def test_centroid_sums():
    rng = random.Random(7)
    for n in (1, 2, 3, 50, 400):
        for shape in ("path", "star", "random"):
            parents = [-1] + [{"path": v - 1, "star": 0, "random": rng.randrange(v)}[shape] for v in range(1, n)]
            own = [[rng.randrange(9) for _ in range(n)] for _ in range(2)]
            want = [list(x) for x in own]
            for v in range(n - 1, 0, -1):
                for x in want:
                    x[parents[v]] += x[v]
            assert centroids._subtree_sums(parents, own) == want
