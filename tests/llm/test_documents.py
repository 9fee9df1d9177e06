"""Document operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from odd_rows import sentence

from mediaweave.llm import decontaminate, matching, neardup, paragraphs, quality, repeats, sketches

KIND = "doc_id long, text string"


def words(text):
    return (text or "").encode().lower().split()


def clusters(items, alike):
    """Smallest member of each item's component."""
    names = sorted(items)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if alike(items[a], items[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {n: find(n) for n in names}


def close(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def copies(rng, n, changes, size=60):
    """A text and n copies of it with some words changed."""
    base = sentence(rng, size).split(" ")
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    rng = random.Random(shingle)
    texts = [sentence(rng, rng.randrange(1, 80)) for _ in range(60)]
    texts += copies(rng, 120, 8) + copies(rng, 10, 3) + copies(rng, 3, 2, 12) + ["a b", "A  B", "a", "a", "", None]
    docs = spark.createDataFrame([(i * 3 - 50, t) for i, t in enumerate(texts)], KIND)

    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = {i * 3 - 50: shingles(t) for i, t in enumerate(texts)}
    wanted = clusters(sets, close)
    got = neardup.near_duplicates(docs, shingle).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (i, len(s), wanted[i], wanted[i] == i) for i, s in sets.items()
    }


def test_one_crowded_group(spark):
    """A large chain of near copies in small blocks: all comparisons that matter are made."""
    rng = random.Random(9)
    w = sentence(rng, 80).split(" ")
    texts = []
    for i in range(150):  # each differs a little from the one before, much from those far away
        w = list(w)
        w[rng.randrange(80)] = f"y{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    sets = {i: {tuple(words(t)[j : j + 2]) for j in range(79)} for i, t in enumerate(texts)}
    wanted = clusters(sets, close)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == wanted and len(set(got.values())) < 20


def test_forest_shape_keeps_recall():
    for n in (10, 10**4, 10**7, 10**10):
        depth, trees = neardup.forest_shape(n, 80)
        assert (1 - 0.8**depth) ** trees <= neardup.MISS
    assert neardup.forest_shape(10**10, 80)[0] > neardup.forest_shape(10**4, 80)[0]


def brute_cuts(text, radius):
    """Places where a paragraph starts: the hash of a word and the next is less than all before and no more than all after it."""
    w = [xxhash.xxh3_64_intdigest(x) for x in words(text)]

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    h = [mixed((mixed(x) + y) % 2**64) for x, y in zip(w, [*w[1:], 0])]
    return [
        i for i, x in enumerate(h)
        if i == 0 or all(y > x for y in h[max(0, i - radius) : i]) and i >= radius and all(y >= x for y in h[i + 1 : i + 1 + radius])
        or 0 < i < radius and all(y > x for y in h[:i]) and all(y >= x for y in h[i + 1 : i + 1 + radius])
    ]


def brute_paragraphs(rows, least, radius):
    """(doc_id, paragraph, first_word, past_word, first_doc_id, first_paragraph, members, removed) of rows (doc_id, text)."""
    sets, spans = {}, {}
    for k, (i, t) in enumerate(rows):
        w, at = words(t), brute_cuts(t, radius)
        for p, (a, b) in enumerate(zip(at, [*at[1:], len(w)])):
            sets[(i, p, k)] = {tuple(w[j : j + 5]) for j in range(a, max(a + 1, b - 4))} if b - a >= 5 else {tuple(w[a:b])}
            spans[(i, p, k)] = (a, b)
    first = clusters(sets, close)
    sizes = {f: sum(g == f for g in first.values()) for f in first.values()}
    out = set()
    for i, p, k in sets:
        if sizes[first[(i, p, k)]] > 1:
            low = high = p
            while sizes.get(first.get((i, low - 1, k)), 0) > 1:
                low -= 1
            while sizes.get(first.get((i, high + 1, k)), 0) > 1:
                high += 1
            if spans[(i, high, k)][1] - spans[(i, low, k)][0] >= least:
                f = first[(i, p, k)]
                out.add((i, p, *spans[(i, p, k)], *f[:2], sizes[f], f != (i, p, k)))
    return out


def paragraph_rows(got):
    names = "doc_id paragraph first_word past_word first_doc_id first_paragraph members removed".split()
    return sorted(tuple(r[n] for n in names) for r in got.collect())


@pytest.mark.parametrize("least,radius", [(20, 12), (1, 12), (1, 3)])
def test_paragraphs(spark, least, radius):
    """Passages of many lengths amid other text, wrapped anew, near copies and texts of a few words."""
    rng = random.Random(least + radius)
    passages = [sentence(rng, n, 5000) for n in (8, 14, 22, 30, 51, 60, 120)]
    texts = []
    for _ in range(40):
        parts = [sentence(rng, rng.randrange(0, 40), 5000) for _ in range(4)]
        for _ in range(2):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        text = " ".join(parts).split(" ")
        for k in range(0, len(text), rng.randrange(5, 30)):
            text[k] += rng.choice(["\n", " \n\n", "\t"])
        texts.append(" ".join(text))
    texts += copies(rng, 40, 2, 40) + copies(rng, 10, 1, 14) + ["one", "One", "two", "a b", "A\nb", "b a", "", None, " \n"]
    texts += [" ".join(["same"] * 500), " ".join(["same"] * 400)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, KIND)
    wanted = brute_paragraphs(rows, least, radius)
    assert len(wanted) > 60
    assert paragraph_rows(paragraphs.duplicate_paragraphs(docs, least, radius=radius)) == sorted(wanted)
    kept = {r.doc_id: r.text for r in paragraphs.without_duplicate_paragraphs(docs, least, radius=radius).collect()}
    for i, t in rows:
        gone = {k for r in wanted if r[0] == i and r[-1] for k in range(r[2], r[3])}
        if gone:
            assert kept[i].split() == [w for k, w in enumerate(t.split()) if k not in gone]
        else:
            assert kept[i] == t


def test_paragraphs_of_repeated_rows(spark):
    """Of equal rows one keeps the text; rows of one id with different texts are told apart."""
    rng = random.Random(2)
    a, b, c = (sentence(rng, 60, 5000) for _ in range(3))
    docs = spark.createDataFrame([(6, a), (6, a), (6, b), (7, c + "\n" + b), (None, b)], KIND)
    kept = sorted((r.doc_id or 0, r.text) for r in paragraphs.without_duplicate_paragraphs(docs).collect())
    assert [t for i, t in kept if i == 0] == [b]
    assert sorted(t for i, t in kept if i == 6) == sorted(["", a, b])
    (seven,) = [t for i, t in kept if i == 7]
    assert seven.startswith(c + "\n") and len(seven.split()) < 90


@pytest.mark.parametrize("vocabulary", [2, 3000])
def test_repeated_passages(spark, vocabulary):
    rng = random.Random(vocabulary)
    passages = [sentence(rng, n, vocabulary) for n in (29, 30, 31, 45, 70)]
    texts = []
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(0, 40), vocabulary) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], " ".join(["x"] * 100), None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    span = 30
    seen, first = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - span + 1):
            g = tuple(w[j : j + span])
            seen[g] = seen.get(g, 0) + 1
            first.setdefault(g, (i, j))

    def united(starts):
        out = []
        for s in starts:
            if out and s <= out[-1][1]:
                out[-1][1] = s + span
            else:
                out.append([s, s + span])
        return out

    wanted = set()
    for i, t in enumerate(texts):
        w = words(t)
        grams = [tuple(w[j : j + span]) for j in range(len(w) - span + 1)]
        later = united([j for j, g in enumerate(grams) if seen[g] > 1 and first[g] != (i, j)])
        for a, b in united([j for j, g in enumerate(grams) if seen[g] > 1]):
            wanted.add((i, a, b, tuple((x, y) for x, y in later if a <= x and y <= b)))
    got = repeats.repeated_passages(docs, span=span).collect()
    assert {(r.doc_id, r.first_word, r.past_word, tuple(map(tuple, r.later))) for r in got} == wanted


def decontamination(texts, items, window=10):
    out = []
    for t in texts:
        w = matching.normal_words(t and t.encode())
        hit, found = set(), set()
        for name, item in items:
            v = matching.normal_words(item and item.encode())
            k = min(window, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if grams and tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add(name)
        out.append((len(w), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return out


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontamination(spark, block_words):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.randrange(0, 30), 6)) for i in range(12)] + [(100, "Solo"), (7, "extra w1"), (None, "w5 w5 w5")]
    texts = [sentence(rng, rng.randrange(0, 120), 6) for _ in range(40)] + [None, "", "SOLO-flight", "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, block_words=block_words).collect()
    rows = {r.row.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in got}
    assert [rows[i] for i in range(len(texts))] == decontamination(texts, items)


def test_blocks_of_capitals(spark):
    """Capitals count as words when a benchmark is cut into blocks."""
    rng = random.Random(3)
    items = [(i, sentence(rng, 25, 6).upper()) for i in range(12)]
    texts = [sentence(rng, rng.randrange(0, 120), 6) for _ in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate._automata(bench, 10, 100))) == 3
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    rows = {r.row.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.scan(docs, bench, block_words=100).collect()}
    assert [rows[i] for i in range(len(texts))] == decontamination(texts, items)


def test_removed_spans(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 25, 2000)) for i in range(5)]
    clean = sentence(rng, 60, 2000)
    texts = [clean, f"Keep this, {items[0][1]} And that! " + sentence(rng, 40), items[1][1], None]
    split = items[2][1].split(" ")  # a passage whose removal brings another one together
    texts.append(clean + " " + " ".join(split[:12]) + " " + items[3][1] + " " + " ".join(split[12:]) + " " + sentence(rng, 60))
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], KIND + ", n_chars int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert sorted(got) == [0, 1, 3, 4] and got[0].text == clean and got[3].text is None
    assert got[1].text.startswith("Keep this, ") and " And that! " in got[1].text and got[1].n_chars == len(got[1].text)
    assert all(r[1] == 0 for r in decontamination([r.text for r in got.values()], items))


def test_quality_measures(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(80):
        lines = [sentence(rng, rng.randrange(0, 12), rng.choice([2, 9, 400])) for _ in range(rng.randrange(1, 8))]
        lines += rng.choices(lines, k=rng.randrange(3))
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(lines) + rng.choice(["", " # $", "|<>", "\x0b\xa0é"]))
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    for r in quality.with_quality(docs).collect():
        t = texts[r.row.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        repeated = {p for i, g in enumerate(windows) if windows.count(g) > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated),
        )
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A plain sentence of several words.", False),
        ('"Is it?" she asked, and left!', False),
        ("He said: (no more).", False),
        ("Ein Satz mit Umlauten, schön und gut;", False),
        ("A heading without an end", True),
        ("Home | About | Contact | Help.", True),
        ("Read more", True),
        ("word### other*** more$$$ and%%% this.", True),
        ("EVERYTHING IS SHOUTED HERE, REALLY.", True),
        ("We use cookies to improve the site.", True),
    ],
)
def test_line_rules(spark, line, fails):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality.line_fails(F.lit(line))).first()[0] is fails


def test_lines_removed_and_documents_rejected(spark):
    rng = random.Random(8)
    good = [sentence(rng, 30).capitalize() for _ in range(3)]
    docs = spark.createDataFrame(
        [(1, "\n".join(["Home | Shop | News | Help", good[0], "", good[1]]), 1), (2, good[0] + "\n" + "menu " * 50, 1)],
        KIND + ", n_chars long",
    )
    got = quality.clean_documents(docs).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in got] == [(1, good[0] + "\n" + good[1], len(good[0]) + len(good[1]) + 1)]


def test_items_are_listed_as_text(spark):
    docs = spark.createDataFrame([(1, "a b c d")], KIND)
    bench = spark.createDataFrame([(10, "a b"), (9, "c"), (9, "d")], "item_id long, text string")
    row = decontaminate.scan(docs, bench).first()
    assert row["items"] == ["10", "9"] and hashlib.sha256(b"10,9").hexdigest()


def test_one_document_of_a_group_stays(spark):
    rng = random.Random(21)
    one, two = copies(rng, 1, 1)
    other = sentence(rng, 60)
    rows = [(5, one, 1), (5, two, 2), (5, other, 3), (5, other, 3), (9, one, 4), (None, one, 5), (None, one, 6), (7, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = neardup.without_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.size in (1, 2) and "near" or str(r.size)) for r in got) == [
        ("5", "3"), ("5", "near"), ("7", "7"), ("8", "8"), ("None", "5"), ("None", "6"),
    ]


@pytest.mark.parametrize("partitions", ["1", "60"])
def test_neighbours_across_partitions(spark, partitions):
    """Equal suffixes are split over many partitions, one row in some of them; rows repeated whole are one text."""
    rng = random.Random(8)
    passage = sentence(rng, 60, 5000)
    texts = [(i, f"{sentence(rng, 20, 5000)} {passage} {sentence(rng, 20, 5000)}") for i in range(40)]
    texts += [(100 + i, sentence(rng, 90, 5000)) for i in range(40)]
    texts += [(500, sentence(rng, 55, 5000))] * 300 + [(600, sentence(rng, 55, 5000))]
    docs = spark.createDataFrame(texts, KIND)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, (partitions, "false")):
            spark.conf.set(name, value)
        got = repeats.repeated_passages(docs).collect()
    finally:
        for name, value in zip(names, old):
            spark.conf.set(name, value)
    want = [(i, 20, 80, [] if i == 0 else [(20, 80)]) for i in range(40)] + [(500, 0, 55, [])]
    assert sorted((r.doc_id, r.first_word, r.past_word, [tuple(x) for x in r.later]) for r in got) == want


def test_quality_windows_take_one_step_per_word(spark):
    """Windows are hashed in one pass over the words; equal ones and no others are equal."""
    from pyspark.sql import functions as F

    from mediaweave.llm.quality import _windows

    rows = spark.createDataFrame([([*range(8), 99, *range(8)],), (list(range(7)),), ([],)], "a array<bigint>")
    full, short, none = (r.w for r in rows.select(_windows(F.col("a"), 8).alias("w")).collect())
    assert len(full) == 10 and full[0] == full[9] and len(set(full)) == 9
    assert short == [] and none == []


def test_short_passages_keep_paragraphs():
    """of passages of 60 to 80 words in other surroundings, nine in ten hold paragraphs of 20 words that are cut alike."""
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(400):
        passage = rng.integers(0, 2**63, rng.integers(60, 81), dtype=np.uint64)
        spans = []
        for _ in range(2):
            before, after = (rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(2))
            at = paragraphs.cuts(np.concatenate((before, passage, after))) - len(before)
            spans.append({(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if a >= 0 and b <= len(passage)})
        found += sum(b - a for a, b in spans[0] & spans[1]) >= paragraphs.LEAST_WORDS
    assert found >= 360


def test_half_like_paragraphs_are_ruled_out():
    """sketches tell half-like paragraphs from like ones, and bands get longer with the corpus, so what is compared does not grow with its square."""
    assert sketches.floor_of(paragraphs.PERCENT, paragraphs.SKETCH) > 0.6
    shapes = [paragraphs.bands(n) for n in (1_000, 250_000, 20_000_000)]
    assert [rows for rows, _ in shapes] == [2, 3, 4]
    for rows, n in shapes:
        assert (1 - 0.8**rows) ** n <= paragraphs.MISS


def test_packed_keys():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, (50, 7))
    packed = [row.tobytes() for row in paragraphs.packed_keys(keys)]
    assert {len(p) for p in packed} == {7 * paragraphs.KEY_BYTES}
    assert paragraphs.packed_keys(keys[:0]).shape == (0, 7 * paragraphs.KEY_BYTES)
    assert (paragraphs.unpacked_keys(packed) == (keys.view(np.uint64) >> np.uint64(24)).astype(np.int64)).all()
