"""Mixing, token files, languages, licenses, archives and the pipeline."""

import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest
from odd_rows import sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mediaweave.llm import archives, bpe, frames, language, licenses, matching, mixing, notices, phrases, tokens, warc
from mediaweave.llm.tables import documents, stored

MIX = "doc_id long, source string, text string"


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    free, left = set(order), float(sum(sizes.values()))
    while free and left > 1e-9:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * per > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else weight[s] * per
        free -= over or free
        left = sum(sizes.values()) - sum(target[s] for s in order if s not in free)
    return target


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {s: rng.choice([0, 3, 50, 1000, 40_000]) for s in ["a", "b", "é", "Z", "z1", "z2", "\U0001f600", None]}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        assert got == pytest.approx(shares(sizes))


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", None, "c"]), sentence(rng, rng.choice([0, 1, 5, 40, 400]))) for i in range(700)]
    docs = spark.createDataFrame(rows, MIX)
    got = mixing.mix(docs, block=8).collect()
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.row.doc_id is not None)
        taken[r.row.source] = taken.get(r.row.source, 0) + r.taken
    targets = {r.row.source: r.target for r in got}
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 400  # the longest document
    assert not any(r.size and r.taken % r.size for r in got)
    again = mixing.mix(docs.repartition(5), block=8).collect()
    assert {(r.row.doc_id, r.taken) for r in got} == {(r.row.doc_id, r.taken) for r in again}
    words = {r.doc_id: r.n for r in mixing.mixed_documents(docs).groupBy("doc_id").agg(
        F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    total = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(words.values()) == total


def test_documents_stay_whole(spark):
    rng = random.Random(9)
    texts = [rng.choice(["", " \n"]) + "".join(f"w{i}_{j}" + rng.choice([" ", "\n", " \t\n"]) for j in range(97)) for i in range(12)]
    rows = [(i, "abc"[i % 3], t) for i, t in enumerate(texts)] + [(3, "a", texts[3])] * 50
    docs = spark.createDataFrame(rows, MIX)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.row.doc_id] = taken.get(r.row.doc_id, 0) + r.taken
    for most in (2, 10_000):
        got = [(r.doc_id, r.text) for r in mixing.mixed_documents(docs, most).collect()]
        assert sorted(got) == sorted((i, texts[i]) for i, n in taken.items() for _ in range(n // 97))


@pytest.mark.parametrize("rate", [0.4, 1.0, 2.7])
def test_equal_rows_share_their_copies(spark, rate):
    """Equal rows are rounded as one: no meeting of theirs, and any number of them."""
    n = 200_000
    rows = spark.range(n).select(F.lit("s").alias("source"), F.lit(7).cast("bigint").alias("key"), F.col("id").alias("rid"),
                                 F.lit(4.0).alias("size"), F.lit(rate % 1).alias("part"))
    other = spark.createDataFrame([("s", 8, n, 3.0, rate % 1), (None, 9, n + 1, 3.0, rate % 1)], "source string, key long, rid long, size double, part double")
    got = mixing.further_copies(rows.unionByName(other), 16)
    found = got.groupBy((F.col("rid") >= n).alias("other")).agg(F.sum("extra").alias("x"), F.count("*").alias("n"), F.max("extra").alias("m"))
    found = {r.other: r for r in found.collect()}
    assert found[False].n == n and abs(found[False].x - n * (rate % 1)) <= 2 and found[True].n == 2
    assert found[False].m <= 1


def test_mix_of_many_equal_rows(spark):
    docs = spark.range(200_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three four").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "b", sentence(random.Random(1), 400))], "doc_id long, source string, text string"))
    got = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 400 for r in got)


def test_rounding_keeps_expectations(spark):
    """Over many independent sources a document is taken as often as its fraction says."""
    rows = [(s * 10 + d, str(s), d, 1.0 + d, 0.3) for s in range(2000) for d in range(5)]
    units = spark.createDataFrame(rows, "rid long, source string, d int, size double, part double")
    units = units.withColumn("key", F.xxhash64("rid"))
    got = mixing.round_copies(units.select("source", "key", "rid", "size", "part"), 3)
    mean = got.groupBy((F.col("rid") % 10).alias("d")).agg(F.avg("part").alias("m")).collect()
    assert all(abs(r.m - 0.3) < 0.04 for r in mean)


def test_encoder_equals_the_library():
    with open(tokens.tokenizer_file()) as f:
        text = f.read()
    encoder, whole = bpe.Encoder(text, remember=50), Tokenizer.from_str(text)
    rng = random.Random(3)
    parts = [
        "a", "don", "é", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "'", "　", "\xa0", "\x1c", "\x85", "1", "<|endoftext|>",
        "中", "\r\n", "!", "​", "﻿", " \n", "\n ", " ", " ", "ª", "ǅ", "!'s", "word", "Tion,", "{}", "...",
    ]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        ids = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids, repr(t)


def changed_tokenizers():
    """The tokenizer files at hand, and the contract's with one setting changed each."""
    with open(tokens.tokenizer_file("word_bpe_49k.json")) as f:
        yield "words", f.read()
    with open(tokens.tokenizer_file()) as f:
        plain = f.read()
    token = {"id": 50257, "content": "a word", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    changes = {
        "lower": lambda d: d.update(normalizer={"type": "Lowercase"}),
        "prefix": lambda d: d["pre_tokenizer"].update(add_prefix_space=True),
        "no_regex": lambda d: d["pre_tokenizer"].update(use_regex=False),
        "blank_in_token": lambda d: d["added_tokens"].append(token),
        "token_eats_blank": lambda d: d["added_tokens"][0].update(lstrip=True, rstrip=True),
        "truncated": lambda d: d.update(truncation={"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}),
        "digits": lambda d: d.update(
            pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, d["pre_tokenizer"]]}
        ),
    }
    for name, change in changes.items():
        parts = json.loads(plain)
        change(parts)
        yield name, json.dumps(parts)


def test_other_tokenizers_encode_whole_texts():
    rng = random.Random(5)
    parts = ["a", "Word", " ", " ", "  ", "\n", "é", "12", "'s", ".", "<|endoftext|>", "a word", "中", "THE"]
    for name, text in changed_tokenizers():
        assert not bpe.cuts_at_blanks(text), name
        encoder, whole = bpe.Encoder(text), Tokenizer.from_str(text)
        for _ in range(300):
            t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, (name, t)
    with open(tokens.tokenizer_file()) as f:
        assert bpe.cuts_at_blanks(f.read())


def test_token_files(spark, sf_dir):
    whole = Tokenizer.from_file(tokens.tokenizer_file())
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in tokens.token_table(docs).collect()}
    at = 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = np.array([*whole.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_frames():
    rng = random.Random(4)
    docs = [(rng.choice([None, i]), rng.randbytes(4 * rng.choice([0, 1, 50, 3000]))) for i in range(200)]
    out = io.BytesIO()
    writer = frames.Writer(out, frame_ids=4000)
    for d in docs:
        writer.add(*d)
    writer.close()
    data = out.getvalue()
    reader = frames.Reader(io.BytesIO(data), len(data))
    assert list(reader.documents()) == docs and len(reader.entries) > 10
    assert list(reader.documents(70, 90)) == docs[70:90]

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            self.n += max(size, 0)
            return super().read(size)

    source = Counted(data)
    list(frames.Reader(source, len(data)).documents(100, 101))
    assert source.n < len(data) / 3  # only the frames asked for
    harmed = bytearray(data)
    harmed[40] ^= 1
    with pytest.raises(Exception):
        list(frames.Reader(io.BytesIO(bytes(harmed)), len(data)).documents())
    # every frame is a zstandard frame by itself, and plain readers skip the table
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert stream.read().startswith(b"".join(d[1] for d in docs))


def parsed(text: bytes, sample: bytes) -> int:
    """Greedy longest phrases by plain search."""
    n = 0
    for a in range(0, len(text), phrases.STRETCH):
        part = text[a : a + phrases.STRETCH]
        i = 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
    return n


def test_cross_parsing():
    rng = random.Random(5)
    samples = {x: bytes(rng.choices(x.encode() + b" ", k=300)) for x in ("abc", "abcdefg", "xyz")}
    model = phrases.Languages(samples)
    texts = [bytes(rng.choices("abcxyz é".encode(), k=rng.choice([0, 1, 7, 600, 1500]))) for _ in range(30)]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [parsed(t, samples[n]) for n in model.names]


def test_language_of_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.train(docs.filter(~language.held_out()).select("text", "lang"))
    found = language.identify(docs, model).filter(language.held_out("row.doc_id")).collect()
    right = [r.lang_pred == r.row.lang for r in found]
    assert len(right) > 30 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, "12 ½ !"), (3, "Ä")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(odd, model).collect()] == [True, True, False]


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    """Three texts in very many copies teach their language, and so does every label however many there are."""
    made = []
    monkeypatch.setattr(phrases, "Languages", lambda found: made.append(found))
    few = spark.createDataFrame([(i, f"{w} " * 20) for i, w in enumerate(["mizu kawa", "yama sora", "hana tori"])], "i long, text string")
    copied = spark.range(90_000).selectExpr("id % 3 AS i").join(few, "i").selectExpr("'ja' AS lang", "text")
    rare = spark.range(300).selectExpr("'l' || id AS lang", "'palabra ' || repeat(chr(97 + id % 26), 5) AS text")
    blank = spark.range(3).selectExpr("'none' AS lang", "'12 ' || id AS text")
    language.train(copied.unionByName(rare).unionByName(blank))
    found = made[0]
    assert set(found) == {"ja"} | {f"l{i}" for i in range(300)}
    wanted = language.TOTAL_BYTES // 301
    assert len(found["ja"]) == min(wanted, 3 * 200) and all(w in found["ja"] for w in (b"mizu", b"yama", b"hana"))
    rng = random.Random(4)
    texts = [f"{chr(97 + i % 26)}" * rng.randrange(1, 3000) for i in range(400)]
    language.train(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string").repartition(7))
    hashes = spark.createDataFrame([(t[: language.LEAD],) for t in texts], "lead string").distinct()
    order = hashes.orderBy(F.xxhash64("lead")).collect()
    assert made[1]["xx"] == "".join(" " + r.lead for r in order).encode()[: language.LANGUAGE_BYTES]


def test_licenses(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        name, notice = rng.choice(licenses.TEMPLATES)
        w = notice.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = "other"
        texts.append(sentence(rng, rng.randrange(0, 50)) + " " + " ".join(w).upper() + " " + sentence(rng, rng.randrange(0, 50)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = set()
    for i, t in enumerate(texts):
        words = matching.normal_words(t.encode())
        for k, (name, notice) in enumerate(licenses.TEMPLATES):
            v = matching.normal_words(notice.encode())
            places = notices.window_places(len(v), licenses.WINDOW)
            n = 0
            for a, b in places:
                grams = {tuple(v[j : j + 3]) for j in range(a, b - 2)}
                size = b - a
                n += any(
                    100 * len(grams & {tuple(words[j : j + 3]) for j in range(s, s + size - 2)}) >= 80 * len(grams)
                    for s in range(len(words) - size + 1)
                )
            if n and 2 * n >= len(places):
                wanted.add((i, name, k, n))
    for max_words in (10**6, 60):
        got = licenses.license_matches(docs, max_words=max_words).collect()
        assert {(r.doc_id, r.license, r.template, r.windows_found) for r in got} == wanted


def test_every_occurrence_of_a_notice(spark):
    rng = random.Random(7)
    long = sentence(rng, 100, 9000).strip(".").split(" ")
    short = sentence(rng, 24, 9000).strip(".").split(" ")
    other = [f"o{i}" for i in range(500)]
    texts = {
        0: short + other[:30] + short + short + other[:5],
        1: other[:7] + long + other[:200] + long + long,
        2: short[:20],  # shorter than a window
        3: short[:21] + other[:1],
        4: short[:15],  # too little of it
        5: long[:50] + other[:30] + long[50:],  # words inserted
        6: long[:60] + other[:300] + long[36:],  # two that lack a part
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = licenses.license_matches(docs, [("short", " ".join(short)), ("long", " ".join(long))], window=24).collect()
    rows = sorted((r.doc_id, r.license, r.first_word, r.past_word) for r in got if r.doc_id < 6)
    assert rows == [
        (0, "short", 0, 24), (0, "short", 54, 78), (0, "short", 78, 102),
        (1, "long", 7, 107), (1, "long", 307, 407), (1, "long", 407, 507),
        (2, "short", 0, 20), (3, "short", 0, 22), (5, "long", 0, 130),
    ]
    two = sorted((r.first_word, r.past_word) for r in got if r.doc_id == 6)
    assert len(two) == 2 and two[0][1] <= 65 and two[1][0] >= 355


def arc(version, records):
    about = f"{version} 0 someone\n{archives.ARC_FIELDS[version]}\n".encode()
    more = " 200 - - 0 x.arc" if version == "2" else ""
    data = f"filedesc://x.arc 0.0.0.0 19970102030405 text/plain{more} {len(about)}\n".encode() + about + b"\n"
    for url, date, kind, block in records:
        data += f"{url} 1.2.3.4 {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"
    return data


@pytest.mark.parametrize("version", ["1", "2"])
def test_legacy_records(version):
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>\nhttp://not.a.record 1 2 3 4\n</html>"
    data = arc(version, [
        ("http://a.example/x y", "19980203040506", "text/html", page),
        ("dns:a.example", "199802", "text/dns", b"a.example. 1 IN A 1.2.3.4"),
        ("http://b.example/", "99999999999999", "image/gif", b"GIF89a"),
        ("http://c.example/", "20000101000000", "text/html", b""),
    ])
    records = list(archives.read_arc(io.BytesIO(gzip.compress(data))))
    assert [r["URL"] for r in records[1:]] == ["http://a.example/x y", "dns:a.example", "http://b.example/", "http://c.example/"]
    assert records[1]["block"] == page and records[0]["version"] == version
    out = b"".join(archives.to_warc(r, "x.arc.gz", None) for r in records)
    got = list(archives.read_warc(io.BytesIO(out)))
    assert [f["warc-type"] for f, _ in got] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert got[1][1] == page and got[1][0]["warc-date"] == "1998-02-03T04:05:06Z"
    assert got[2][0]["warc-date"] == "1998-02-01T00:00:00Z" and got[3][0]["warc-date"] == "1970-01-01T00:00:00Z"
    payload = page.partition(b"\r\n\r\n")[2]
    assert got[1][0]["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert len({f["warc-record-id"] for f, _ in got}) == 5
    assert out == b"".join(archives.to_warc(r, "x.arc.gz", None) for r in records)


def test_damaged_archives():
    data = arc("1", [("http://a.example/", "19980203040506", "text/html", b"12345")])
    cut = list(archives.read_arc(io.BytesIO(gzip.compress(data[:-3]))))
    assert cut[-1]["short"] and b"WARC-Truncated: length" in gzip.decompress(archives.to_warc(cut[-1], "x", None))
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(gzip.compress(data + b"no header\n"))))
    whole = archives.to_warc(cut[-1], "x", None)
    harmed = gzip.compress(gzip.decompress(whole).replace(b"\r\n\r\n12", b"\r\n\r\n21"))
    with pytest.raises(ValueError):
        list(archives.read_warc(io.BytesIO(harmed)))


def test_page_archive(spark):
    big, small = "x" * 100, "y" * 99
    pages = [(5, "http://a b", big), (3, "u", big), (9, None, big), (9, "v", big), (None, "w", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", "é" * 50), (7, "u", "é" * 50)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = warc.page_archive(spark, table).collect()
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == sorted([
        (3, 100, "response", None), (5, 100, "revisit", 3), (9, 100, "revisit", 3), (9, 100, "revisit", 3), (0, 100, "revisit", 3),
        (1, 99, "response", None), (2, 99, "response", None), (4, 0, "response", None), (6, 100, "response", None), (7, 100, "revisit", 6),
    ], key=str)
    assert {r.payload_digest for r in rows if r.page_id == 4} == {hashlib.sha256(b"").hexdigest()}


def test_pages_of_any_url_come_back(spark):
    pages = [(1, "dns:a.example", "x" * 100), (2, "http://a.example/", "x" * 100), (3, "dns:b.example", "short"), (4, "dns:c.example", None)]
    rows = warc.page_archive(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows) == [
        (1, 100, "response", None), (2, 100, "revisit", 1), (3, 5, "response", None), (4, 0, "response", None),
    ]


def test_many_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = tokens.shared_folder(spark, "arc-test")
    arcs = warc.write_arc(pages, folder, archive_bytes=20_000).collect()
    assert len(arcs) > 3 and sum(r.n_records for r in arcs) == pages.count()


def test_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stored(stage(spark, left, sf_dir), "stage")
        assert left.dtypes == docs.dtypes
        assert left.join(before, "doc_id", "left_anti").count() == 0
    assert sum(r.n for r in left.groupBy().agg(F.count("*").alias("n")).collect()) > 0
    got = corpus_pipeline.run(spark, sf_dir)
    wanted = left.groupBy("doc_id").count()
    assert {(r["doc_id"], r["count"]) for r in wanted.collect()} == {(r["doc_id"], r["count"]) for r in got.groupBy("doc_id").count().collect()}


def test_files_follow_the_order_of_ids(spark):
    """Over many partitions, with null and repeated ids: files in order, places without gaps."""
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(-50, 400)]), sentence(rng, rng.randrange(0, 30))) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = tokens.shared_folder(spark, "tokens-test")
        manifest = tokens.write_tokens(docs, folder)
        got = tokens.read_tokens(manifest, folder, with_ids=True).orderBy("start").collect()
        assert manifest.filter("n_docs > 0").count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
