"""Passages of ``SPAN`` words or more that repeat, by a sparse suffix array.

Of all suffixes of a text only those at minimiser positions are kept: the anchor of a window of ``SPAN``
words is the least five-word hash near its start, a choice by content, so equal windows keep equal suffixes.

The suffixes are sorted over the cluster by their next ``AHEAD`` words, a byte of each word's hash after the other, and each is
compared with its neighbours: those that share all ``AHEAD`` words with the one before or behind go on.  Suffixes that are equal there
are split between partitions like any others, so the first and last row of each partition are compared once more.  A byte that two
words share by chance only makes a neighbour that the next step finds unlike.

Suffixes that agree in all windows they are the anchor of are one class, whose copies need no comparison.  Where a
neighbourhood has several classes, the text of a member of each is read again, extended to the left by each number of words its
windows allow and to the right to ``SPAN`` words, and compared with the others.  So a window is found exactly when
it occurs twice or more, and a passage is a chain of such windows.  Aggregations combine equal keys before the shuffle,
and the tables that joins meet on a common key are written first, so that adaptive execution can split it.

These comparisons are between 64-bit hashes of word sequences.  Words are separated by white space, A-Z in lower case.

Defined results: null and empty texts, and those of fewer words, have no passage; a text may repeat itself;
rows without an id are neither searched nor matched; of rows with one id and different texts each is searched, and
rows that are repeated whole repeat each other, with one result for all of them.  Of a repeated window the first occurrence is
the one with the smallest doc_id, then place; if the row is repeated, in each of its copies.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm import sketches, suffixes
from mediaweave.llm.tables import forget, stored

SPAN = 50
GRAM = 5
#: Places at a window's start among which its anchor is chosen.
REACH = 25
#: Words from an anchor on that every window of it holds.
AHEAD = SPAN - REACH + 1

_KEPT = "array<struct<back:int,first_doc:bigint,first_at:bigint>>"


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("doc_id IS NOT NULL")


def _anchors(docs: DataFrame, span: int) -> DataFrame:
    """Sparse suffixes: doc_id, text_key, place, back and near (farthest and nearest window start), class hash and
    ``next``, a byte for each of the next words."""
    reach, ahead = REACH, span - REACH + 1

    def run(batches):
        memo, powers = sketches.WordHashes(), suffixes.Powers()
        names = ["doc_id", "text_key", "place", "back", "near", "class", "next"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64()]
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0

        def packed():
            columns = [pa.array(np.concatenate(h), k) for h, k in zip(held, kinds)]
            ends = pa.py_buffer(np.arange(0, (size + 1) * ahead, ahead, dtype=np.int32))
            following = pa.Array.from_buffers(pa.binary(), size, [None, ends, pa.py_buffer(np.concatenate(held[-1]))])
            return pa.RecordBatch.from_arrays([*columns, following], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = memo.of((text.as_py() or b"").lower().split())
                seq = suffixes.Sequence(words, powers)
                at, first, last = suffixes.anchors(seq, span, GRAM, reach)
                if not len(at):
                    continue
                whole = seq.stretch(np.array([0]), np.array([seq.n])).view(np.int64)[0]
                # the class covers every window of the anchor, and where they start
                stretch = sketches.mixed(seq.stretch(first, last + span) + ((at - first) * 64).astype(np.uint64))
                following = (words >> np.uint64(56)).astype(np.uint8)[at[:, None] + np.arange(ahead)]
                row = (np.full(len(at), doc_id), np.full(len(at), whole), at, at - first, at - last, stretch.view(np.int64), following)
                for h, values in zip(held, row):
                    h.append(values)
                size += len(at)
                if size > 100_000:
                    yield packed()
                    held, size = [[] for _ in names], 0
        if size:
            yield packed()

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, place int, back short, near short, class long, next binary")


def _with_neighbours(found: DataFrame, ahead: int) -> DataFrame:
    """Suffixes that share their next words with a neighbour in sorted order; ``ahead`` is the hash of these words."""
    order = ["next", "doc_id", "place", "text_key"]
    array = found.repartitionByRange(*order).sortWithinPartitions(*order)

    def chosen(rows: pa.RecordBatch, before: np.ndarray, behind: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        sure = np.maximum(before, behind) >= ahead
        rows = rows.append_column("sure", pa.array(sure)).append_column("edge", pa.array(edge))
        return rows.filter(pa.array(sure | edge))

    def run(batches):
        last, before, alone = None, 0, True  # the last row so far, the words it shares with the one before, if there is one
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            n = rows.num_rows
            words = np.frombuffer(b"".join(rows.column("next").to_pylist()), np.uint8).reshape(n, ahead)
            same = np.logical_and.accumulate(words[1:] == words[:-1], axis=1).sum(axis=1)
            shared = np.concatenate(([before], same))
            edge = np.zeros(n - 1, bool)
            edge[:1] = alone
            yield chosen(rows.slice(0, n - 1), shared[:-1], shared[1:], edge)
            last, before, alone = rows.slice(n - 1), shared[-1], alone and n == 1
        if last is not None:
            yield chosen(last, np.array([before]), np.zeros(1), np.ones(1, bool))

    rows = array.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in found.dtypes)}, sure boolean, edge boolean")
    rows = stored(rows.withColumn("ahead", F.xxhash64("next")).drop("next"), "neighbours")
    # two rows of a partition at most: the neighbours of these are the edges of other partitions
    edges = rows.filter("edge").groupBy("ahead").agg(F.count("*").alias("n")).filter("n > 1").select("ahead")
    across = rows.filter("edge AND NOT sure").join(edges, "ahead", "left_semi")
    return rows.filter("sure").unionByName(across).drop("sure", "edge")


def _windows(docs: DataFrame, classes: DataFrame, span: int) -> DataFrame:
    """Windows of the classes' first suffixes: class, n, back, hash, first_doc, first_at."""
    asked = classes.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("class", "n", "place", "back", "near")).alias("asked"))

    def run(batches):
        memo, powers = sketches.WordHashes(), suffixes.Powers()
        names = ["class", "n", "back", "hash", "first_doc", "first_at"]
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            lists = batch.column("asked")
            flat = lists.flatten()
            class_, n, place, back, near = (flat.field(k).to_numpy().astype(np.int64) for k in range(5))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                seq = suffixes.Sequence(memo.of((text.as_py() or b"").lower().split()), powers)
                if seq.stretch(np.array([0]), np.array([seq.n])).view(np.int64)[0] != keys[i]:
                    continue  # another text of the same id
                a, b = ends[i], ends[i + 1]
                back_to, sizes = back[a:b], back[a:b] - near[a:b] + 1
                of = np.repeat(np.arange(b - a), sizes)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                backs = back_to[of] - nth
                start = place[a:b][of] - backs
                found = seq.stretch(start, start + span).view(np.int64)
                columns = [class_[a:b][of], n[a:b][of], backs.astype(np.int32), found, np.full(len(of), ids[i]), start]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    texts = _texts(docs)
    rows = asked.join(texts, "doc_id")
    # a row that is there several times is asked once
    rows = rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key", "h"]).drop("h")
    return rows.mapInArrow(run, "class long, n long, back int, hash long, first_doc long, first_at long")


def repeated_passages(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Passages whose every ``span``-word window repeats: doc_id, text_key, first_word, past_word, and ``later``, the
    stretches of them that are not the first occurrence."""
    if span < REACH + GRAM:
        raise ValueError(f"a passage must have at least {REACH + GRAM} words")
    found = stored(_anchors(docs, span), "suffixes")
    close = _with_neighbours(found, span - REACH + 1)
    place = F.struct("doc_id", "place", "text_key", "back", "near")
    classes = close.groupBy("ahead", "class").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classes = stored(classes.select("ahead", "class", "n", "first.*"), "classes")
    forget(found)
    several = stored(classes.groupBy("ahead").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("ahead"), "several")
    # one class alone: if it has several members, all its windows repeat
    alone = classes.filter("n > 1").join(several, "ahead", "left_anti").select(
        "class",
        F.transform(
            F.sequence(F.col("near").cast("int"), F.col("back").cast("int")),
            lambda b: F.struct(
                b.alias("back"), F.col("doc_id").alias("first_doc"), (F.col("place") - b).cast("bigint").alias("first_at")
            ),
        ).alias("windows"),
    )
    windows = stored(_windows(docs, classes.join(several, "ahead", "left_semi"), span), "windows")
    again = windows.groupBy("hash").agg(
        F.sum("n").alias("total"), F.min(F.struct("first_doc", "first_at")).alias("first")
    ).filter("total > 1").select("hash", "first.*")
    again = stored(again, "again")
    kept = windows.select("class", "back", "hash").join(again, "hash")
    kept = kept.groupBy("class").agg(F.collect_list(F.struct("back", "first_doc", "first_at")).alias("windows"))
    repeated = stored(alone.unionByName(kept.select("class", F.col("windows").cast(_KEPT))), "repeated")
    forget(classes, several, windows, again)
    hits = close.select("doc_id", "text_key", "place", "class").join(repeated, "class")
    starts = F.transform(
        "windows",
        lambda w: F.struct(
            (F.col("place") - w.back).cast("int").alias("start"),
            ((w.first_doc != F.col("doc_id")) | (w.first_at != F.col("place") - w.back)).alias("later"),
        ),
    )
    # a set: equal rows name the same windows, and are one before the shuffle
    per_text = hits.select("doc_id", "text_key", starts.alias("starts")).groupBy("doc_id", "text_key")
    per_text = per_text.agg(F.flatten(F.collect_set("starts")).alias("starts"))
    kind = "doc_id long, text_key long, first_word long, past_word long, later array<struct<first_word:int,past_word:int>>"
    return per_text.mapInArrow(_chained(span), kind)


def _chained(span: int):
    """Unite the windows of a text, given by their starts, to passages."""

    def united(text: np.ndarray, start: np.ndarray):
        """First and last window of every chain of windows that touch, and the chain of each window."""
        fresh = np.ones(len(start), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (start[1:] - start[:-1] > span)
        first = np.flatnonzero(fresh)
        return first, np.concatenate((first[1:], [len(start)])) - 1, np.cumsum(fresh) - 1

    def run(batches):
        names = ["doc_id", "text_key", "first_word", "past_word", "later"]
        for batch in batches:
            lists = batch.column("starts")
            flat = lists.flatten()
            if not len(flat):
                continue
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            start = flat.field(0).to_numpy().astype(np.int64)
            late = flat.field(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((start, text))
            text, start, late = text[order], start[order], late[order]
            first, last, chain = united(text, start)
            again = np.flatnonzero(late)
            later_first, later_last, _ = united(text[again], start[again]) if len(again) else (again, again, again)
            counts = np.bincount(chain[again[later_first]], minlength=len(first))
            spans = pa.StructArray.from_arrays(
                [pa.array(start[again[later_first]], pa.int32()), pa.array(start[again[later_last]] + span, pa.int32())],
                names=["first_word", "past_word"],
            )
            owner = pa.array(text[first])
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(start[first]), pa.array(start[last] + span)]
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, spans)], names=names)

    return run
