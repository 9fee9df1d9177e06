"""Near-duplicate paragraphs by MinHash banding.

Paragraphs are cut by content: a word starts one if the hash of it and the next word is the least of all within ``RADIUS``
words on either side.  So every word of a text, however it is wrapped into lines, is in exactly one paragraph, and a passage that
stands in two texts is cut alike in both but for its ends.  The five-word shingle sets of paragraphs (of fewer words, all of
it is one shingle) are minhashed into bands, tuned for recall: a pair at the wanted similarity shares no band with a
chance of ``MISS`` only.  A band's rows follow from the number of documents, so that unlike paragraphs seldom collide.  Paragraphs that collide in a band are verified by the exact Jaccard similarity of their sets, and
linked paragraphs form components; the first paragraph of a component, by doc_id and place, stays and the others are removed.

Neighbouring paragraphs with a like one elsewhere are a passage; passages of fewer than ``LEAST_WORDS`` words, such as a
phrase or a short line, are left alone: neither reported nor removed.

Equal paragraphs are one item from the start, and crowded bands are worked through without spreading their pairs
(``linking``).  Sets so small that one shingle more or less is too much (``least_size``) can only be like
equal ones, so they need no bands.

Defined results: null and empty texts have no paragraphs; a paragraph may repeat one of its own document; rows
without an id are neither searched nor matched; repeated rows are copies of each other, and of rows with one id
and different texts each is searched.  Columns of the input travel in one struct where the text is rewritten;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaweave.llm import sketches
from mediaweave.llm.forest import shared_regions
from mediaweave.llm.linking import linked
from mediaweave.llm.tables import forget, stored

SHINGLE = 5
#: A paragraph has more than this many words, but for the ends of a text, and twice as many on average.
RADIUS = 9
LEAST_WORDS = 20
PERCENT = 80
MISS = 1e-2
#: Minhashes that estimate the similarity of a pair: enough that half-like ones, whose number grows with the square of the input, are ruled out.
SKETCH = 128
#: Similarity of unlike paragraphs that a band's rows are made for.
UNLIKE = 0.01
#: Bytes of a band's key.
KEY_BYTES = 5
#: Text that is cut at a time.
GROUP_BYTES = 1 << 21
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def bands(n_docs: int, percent: int = PERCENT, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): so many rows that the chance collisions of an unlike paragraph do not grow with the number of documents,
    and as many bands as the wanted recall takes."""
    rows = max(2, math.ceil(math.log(max(n_docs, 2)) / -math.log(UNLIKE)))
    return rows, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1


def packed_keys(keys: np.ndarray) -> np.ndarray:
    """Per row the leading bytes of its 64-bit band keys, end to end."""
    top = np.ascontiguousarray(keys).view(np.uint64) >> np.uint64(64 - 8 * KEY_BYTES)
    return top.astype("<u8").view(np.uint8).reshape(*keys.shape, 8)[:, :, :KEY_BYTES].reshape(len(keys), keys.shape[1] * KEY_BYTES)


def unpacked_keys(packed: list[bytes]) -> np.ndarray:
    """Per row the band keys of a packed one, all of one length."""
    parts = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1, KEY_BYTES)
    out = np.zeros((*parts.shape[:2], 8), np.uint8)
    out[:, :, :KEY_BYTES] = parts
    return out.view("<i8").reshape(parts.shape[:2])


def _keyed(items: DataFrame) -> DataFrame:
    """(tree, key, item) of the band keys of (item, keys), each behind the number of its tree."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = unpacked_keys(batch.column(1).to_pylist())
                n, trees = keys.shape
                keys |= np.arange(trees) << (8 * KEY_BYTES)
                columns = [np.tile(np.arange(trees, dtype=np.int32), n), keys.ravel(), np.repeat(batch.column(0).to_numpy(), trees)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "key", "item"])

    return items.select("item", "keys").mapInArrow(run, "tree int, key long, item long")


def least_size(percent: int = PERCENT) -> int:
    """The fewest shingles of a set that can be like a different one: it and one more must be alike."""
    return math.ceil(percent / (100 - percent)) if percent < 100 else 1


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def cuts(words: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Where the paragraphs of a text begin, and its number of words at the end; ``words`` are hashes."""
    return _cuts_of(words, np.array([len(words)]), radius) if len(words) else np.zeros(1, np.int64)


def _cuts_of(words: np.ndarray, lengths: np.ndarray, radius: int) -> np.ndarray:
    """The same for texts that stand end to end in one array; none is empty."""
    ends = np.cumsum(lengths)
    after = np.append(words[1:], np.uint64(0))
    after[ends - 1] = 0
    h = sketches.mixed(sketches.mixed(words) + after)
    # a wall on either side of every text
    at = np.arange(len(words)) + np.repeat(np.arange(1, len(lengths) + 1) * radius, lengths)
    walled = np.full(len(words) + (len(lengths) + 1) * radius, np.iinfo(np.uint64).max, np.uint64)
    walled[at] = h
    least = _least_of(walled, radius)
    starts = (least[at - radius] > h) & (least[at + 1] >= h)
    starts[ends - lengths] = True
    return np.append(np.flatnonzero(starts), len(words))


def _sets_of(words: np.ndarray, lengths: np.ndarray, radius: int):
    """All paragraphs of texts that stand end to end: (cuts), and their shingle sets end to end: hashes, where each starts, sizes."""
    at = _cuts_of(words, lengths, radius)
    m, n, n_words = len(at) - 1, len(words), np.diff(at)
    units, hashes = [], []
    if n >= SHINGLE:
        x = sketches.mixed(words[: n - SHINGLE + 1] + np.uint64(SHINGLE))
        for j in range(1, SHINGLE):
            x = sketches.mixed(x * sketches._A + words[j : n - SHINGLE + 1 + j])
        unit = np.repeat(np.arange(m), n_words)[: len(x)]
        whole = np.arange(len(x)) + SHINGLE <= at[unit + 1]
        units.append(unit[whole])
        hashes.append(x[whole])
    for width in range(1, SHINGLE):
        short = np.flatnonzero(n_words == width)
        x = sketches.mixed(words[at[short]] + np.uint64(width))
        for j in range(1, width):
            x = sketches.mixed(x * sketches._A + words[at[short] + j])
        units.append(short)
        hashes.append(x)
    unit, x = np.concatenate(units), np.concatenate(hashes)
    order = np.argsort(unit, kind="stable")  # all but in order already
    unit, x = unit[order], x[order]
    both = sketches.mixed(x + unit.astype(np.uint64) * sketches._B)
    once = np.sort(both)
    twice = once[1:][once[1:] == once[:-1]]
    if len(twice):  # the few shingles that a paragraph holds again are found and looked at alone
        place = np.minimum(np.searchsorted(twice, both), len(twice) - 1)
        place = np.flatnonzero(twice[place] == both)
        again = np.ones(len(place), bool)
        again[np.unique(both[place], return_index=True)[1]] = False
        unit, x = np.delete(unit, place[again]), np.delete(x, place[again])
    sizes = np.bincount(unit, minlength=m)
    return at, x, np.cumsum(sizes) - sizes, sizes


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts (binary) end to end, and the number of words of each."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(real)))
    bounds = before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    found = flat.dictionary_encode()
    different = found.dictionary.cast(pa.binary()).to_pylist()
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    return names[found.indices.to_numpy()[real]], np.diff(bounds)


def _groups(sizes: list[int], limit: int):
    """(first, past) of consecutive texts of about ``limit`` bytes."""
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held > limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def paragraph_profiles(texts: DataFrame, radius: int, rows_per_band: int, n_bands: int, least: int = 1) -> DataFrame:
    """Paragraphs of (row, doc_id, text): row, doc_id, place, first_word, n_words, size, fingerprint, and of those with ``least``
    shingles band keys."""
    factors = sketches.multipliers(rows_per_band * n_bands)
    names = ["row", "doc_id", "place", "first_word", "n_words", "size", "f1", "f2", "keys"]

    def packed(rows: np.ndarray, ids: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        at, x, starts, sizes = _sets_of(words, lengths, radius)
        text = np.repeat(np.arange(len(lengths)), lengths)[at[:-1]]
        many = np.bincount(text, minlength=len(lengths))
        place = np.arange(len(text)) - (np.cumsum(many) - many)[text]
        first = at[:-1] - (np.cumsum(lengths) - lengths)[text]
        f1 = np.add.reduceat(sketches.mixed(x + sketches._A), starts).view(np.int64)
        f2 = np.bitwise_xor.reduceat(sketches.mixed(x * sketches._A + sketches._B), starts).view(np.int64)
        hashes = sketches.flat_minhashes(x, starts, factors)
        large = sizes >= least
        data = packed_keys(sketches.path_keys(hashes[large], rows_per_band))
        bounds = np.concatenate(([0], np.cumsum(large * (n_bands * KEY_BYTES)))).astype(np.int32)
        present = np.packbits(large, bitorder="little")
        keys = pa.Array.from_buffers(pa.binary(), len(large), [pa.py_buffer(b) for b in (present, bounds, data)])
        columns = [pa.array(c, pa.int64()) for c in (rows[text], ids[text], place, first, np.diff(at), sizes, f1, f2)]
        return pa.RecordBatch.from_arrays([*columns, keys], names=names)

    def run(batches):
        for batch in batches:
            rows, ids = (batch.column(c).to_numpy() for c in range(2))
            texts = batch.column(2).cast(pa.binary())
            for first, past in _groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), GROUP_BYTES):
                words, lengths = _hashed(texts.slice(first, past - first))
                some = lengths > 0
                if some.any():
                    yield packed(rows[first:past][some], ids[first:past][some], words, lengths[some])

    kind = ", ".join(f"{n} long" for n in names[:8]) + ", keys binary"
    return texts.mapInArrow(run, kind)


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, size, sketch, keys, set) of the wanted paragraphs (item, doc_id, first_word, n_words, f1, f2, keys), read from
    their documents once more."""
    one = F.struct("item", "first_word", "n_words", "f1", "f2", "keys")
    rows = wanted.groupBy("doc_id").agg(F.collect_list(one).alias("asked")).join(texts, "doc_id")
    # a row that is there several times is read once
    rows = rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("asked", "text")
    factors = sketches.multipliers(SKETCH)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        items, keys, sets = zip(*held)
        sketch = [s.tobytes() for s in sketches.minhashes(list(sets), factors).astype("u1")]
        columns = [(items, pa.int64()), (list(map(len, sets)), pa.int64()), (sketch, pa.binary()), (unpacked_keys(keys).tolist(), pa.list_(pa.int64()))]
        columns.append(([s.tobytes() for s in sets], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["item", "size", "sketch", "keys", "set"])

    def run(batches):
        memo = sketches.WordHashes()
        held: list[tuple] = []
        for batch in batches:
            for asked, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                words = text.as_py().lower().split()
                for a in asked.as_py():
                    found = sketches.shingles(memo.of(words[a["first_word"] : a["first_word"] + a["n_words"]]), SHINGLE)
                    # rows of a repeated id may hold other texts than the wanted one
                    if sketches.fingerprint(found) == (a["f1"], a["f2"]):
                        held.append((a["item"], a["keys"], found))
                if len(held) >= 4096:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return rows.mapInArrow(run, "item long, size long, sketch binary, keys array<long>, set binary")


def _repeated(texts: DataFrame, least_words: int, percent: int, radius: int) -> DataFrame:
    """Paragraphs in repeated passages of the texts (row, doc_id, text), see ``duplicate_paragraphs``, with their row."""
    rows_per_band, n_bands = bands(texts.count(), percent)
    rows = paragraph_profiles(texts, radius, rows_per_band, n_bands, least_size(percent))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "paragraphs")
    # equal paragraphs are one item: the first of them
    head = F.struct("doc_id", "first_word", "n_words", "keys")
    items = rows.groupBy("f1", "f2").agg(F.min("rid").alias("item"), F.min_by(head, "rid").alias("h"))
    items = stored(items.select("item", "f1", "f2", "h.*"), "items")
    classes = items.select("item", "f1", "f2")
    members = rows.select("rid", "row", "doc_id", "place", "first_word", "n_words", "f1", "f2").join(classes, ["f1", "f2"]).drop("f1", "f2")
    members = stored(members, "members")
    forget(rows)
    every, items = items, items.filter("keys IS NOT NULL")
    regions = shared_regions(_keyed(items))
    wanted = items.join(regions.select("item").distinct(), "item", "left_semi")
    sets = stored(_sets(texts.select("doc_id", "text"), wanted), "sets")
    linked_items = linked(sets.drop("set"), regions, sets.select("item", "set"), percent)
    forget(every, regions, sets)
    found = linked_items.toDF("of", "component")
    placed = members.join(found, F.col("item") == F.col("of"), "left")
    placed = placed.withColumn("component", F.coalesce("component", "item"))
    placed = stored(placed.drop("item", "of"), "placed")
    forget(members, linked_items)
    order = F.struct("doc_id", "place", "rid")
    first = placed.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("members")).filter("members > 1")
    out = placed.join(first, "component")
    # paragraphs of a text were numbered one after the other
    out = out.withColumn("text_at", F.col("rid") - F.col("place"))
    out = out.withColumn("run", F.col("place") - F.row_number().over(W.partitionBy("doc_id", "text_at").orderBy("place")))
    out = out.withColumn("passage", F.sum("n_words").over(W.partitionBy("doc_id", "text_at", "run")))
    return out.filter(F.col("passage") >= least_words).select(
        "row",
        "doc_id",
        F.col("place").alias("paragraph"),
        "first_word",
        (F.col("first_word") + F.col("n_words")).alias("past_word"),
        "n_words",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.place").alias("first_paragraph"),
        "members",
        (F.col("rid") != F.col("first.rid")).alias("removed"),
    )


def duplicate_paragraphs(docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Paragraphs of components of two or more, in passages of ``least_words`` or more: doc_id, paragraph (its number), first_word,
    past_word and n_words, the first paragraph of the component (first_doc_id, first_paragraph), its members, and whether this one
    is removed."""
    texts = docs.select(
        F.lit(0).cast("bigint").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter("doc_id IS NOT NULL")
    return _repeated(texts, least_words, percent, radius).drop("row")


def without_duplicate_paragraphs(
    docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, radius: int = RADIUS
) -> DataFrame:
    """Documents without their removed paragraphs; same columns as ``docs``.  Rows without an id stay whole.

    A paragraph goes with the white space behind it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "texts")
    texts = rows.select(
        F.col("_at").alias("row"), F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text")
    ).filter("doc_id IS NOT NULL")
    gone = _repeated(texts, least_words, percent, radius).filter("removed").groupBy("row")
    gone = gone.agg(F.array_sort(F.collect_list(F.struct("first_word", "past_word"))).alias("_gone")).withColumnRenamed("row", "_of")
    rows = rows.join(gone, F.col("_at") == F.col("_of"), "left").select("row", F.col("row.text").cast("string").alias("_text"), "_gone")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, spans in enumerate(batch.column(2).to_pylist()):
                if spans:
                    texts[i] = without_words(texts[i], [(s["first_word"], s["past_word"]) for s in spans])
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), new, pc.is_valid(batch.column(2))], names=["row", "_text", "_cut"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, _text string, _cut boolean")
    changed = {"text": F.col("_text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        n = F.length("_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_cut"), n).otherwise(F.col("row.n_chars"))
    return out.select([changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of some spans (first, past) in ascending order, and without the white space behind them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for first, past in spans:
        out.append(text[at : starts[first]])
        at = starts[past]
    return b"".join([*out, text[at:]])
