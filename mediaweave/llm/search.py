"""Ranked lexical search of many queries over all documents, with range-maximum tables on posting lists.

The terms of the queries form a vocabulary.  One pass over the documents counts its terms in each; documents are then dealt
into shards of a bounded number of postings, every shard answers all queries exactly (``postings``), and the shards' best
documents meet by query.

Queries may be of any number: they are worked through in blocks of a bounded text size, one vocabulary each.

Defined results: null and empty texts have no terms; documents without terms count for nothing; repeated documents are
ranked row by row, those without a doc_id behind equal scores; equal rows of the queries are one query, and rows of
one item_id with different texts are queries of their own.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaweave.llm.postings import Shard
from mediaweave.llm.tables import forget, stored

TOP = 10
#: Bytes of query text in one block.
BLOCK_BYTES = 8_000_000
#: Postings in one shard, about 0.2 GB of tables.
SHARD_POSTINGS = 1_500_000
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text: letters, digits and all beyond ASCII, A-Z lower-cased."""
    return _TERM.findall((text or b"").lower())


def _blocks(queries: DataFrame, block_bytes: int):
    """Lists of (item_id, text) of a bounded size."""
    items = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("t"))
    items = items.filter("t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(n)) == k).collect()
        yield [(r.item_id, terms_of(bytes(r.t))) for r in rows]


def _profiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every document with terms: its number of terms, and vocabulary terms with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = known.value.get
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            held = 0
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                found = terms_of(texts[i].as_py())
                if found:
                    counts = sorted((t, n) for w, n in Counter(found).items() if (t := number(w)) is not None)
                    ids.append(batch.column(0)[i].as_py())
                    sizes.append(len(found))
                    terms.append([t for t, _ in counts])
                    tfs.append([n for _, n in counts])
                    held += len(counts)
                if held > 1 << 17 or i == batch.num_rows - 1:
                    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
                    columns += [pa.array(x, pa.list_(pa.int32())) for x in (terms, tfs)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])
                    ids, sizes, terms, tfs = [], [], [], []
                    held = 0

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("text IS NOT NULL").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def _document_counts(profiles: DataFrame, size: int) -> DataFrame:
    """(term, df) of the vocabulary's terms, added up in every task first."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "df"])

    return profiles.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: Column, df: Column) -> Column:
    """Whole-number weight of a term that ``df`` of ``n_docs`` documents hold."""
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("bigint")


def _shards(batches):
    """Tables of one shard at a time, from rows sorted by shard."""
    held: list[pa.Table] = []
    for batch in batches:
        at = 0
        names = batch.column(0).to_numpy(zero_copy_only=False)
        for cut in [*(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]:
            part = pa.Table.from_batches([batch.slice(at, cut - at)])
            if held and part.num_rows and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            if part.num_rows:
                held.append(part)
            at = cut
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shard(table: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> Shard:
    """Postings of a shard; documents with the same counts are one, with their smallest ids."""
    one = {c: table.column(c).combine_chunks() for c in ("terms", "tfs")}
    starts = one["terms"].offsets.to_numpy().astype(np.int64)
    terms, tfs = (one[c].values.to_numpy() for c in ("terms", "tfs"))
    sizes, doc_ids = table.column("n").to_numpy(), table.column("doc_id").to_pylist()
    seen: dict[tuple, list] = {}
    first = []
    for i in range(table.num_rows):
        a, b = starts[i], starts[i + 1]
        kind = (int(sizes[i]), terms[a:b].tobytes(), tfs[a:b].tobytes())
        if kind not in seen:
            seen[kind] = []
            first.append(i)
        seen[kind].append(doc_ids[i])
    ids = [sorted(x, key=lambda d: (d is None, d or 0))[:top] for x in seen.values()]
    first = np.array(first, np.int64)
    counts = starts[first + 1] - starts[first]
    pick = np.repeat(starts[first] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    cuts = np.concatenate(([0], np.cumsum(counts)))
    return Shard(sizes[first], cuts, terms[pick], tfs[pick], ids, weights, n_docs, n_terms)


def _best(profiles: DataFrame, queries: list[tuple], weights: np.ndarray, stats, top: int, shard_postings: int) -> DataFrame:
    """The best documents of each shard for each query: query, item_id, doc_id, score."""
    spark = profiles.sparkSession
    n = max(1, math.ceil(stats.postings / shard_postings))
    shared = spark.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shared.value
        for table in _shards(batches):
            shard = _shard(table, weights, stats.docs, stats.terms, top)
            out = []
            for number, (item_id, terms) in enumerate(queries):
                out += [(number, item_id, i, score) for score, i in shard.search(terms, top)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"]
            )

    rows = profiles.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int"))
    rows = rows.select("shard", "doc_id", "n", "terms", "tfs").repartitionById(n, F.col("shard")).sortWithinPartitions("shard")
    return rows.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def ranked(
    docs: DataFrame, queries: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS
) -> DataFrame:
    """The ``top`` documents of every query with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in _blocks(queries, block_bytes):
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
        if not vocabulary:
            continue
        profiles = stored(_profiles(docs, vocabulary), "profiles")
        stats = profiles.agg(
            F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms").cast("bigint")).alias("postings")
        ).first()
        if not stats.postings:
            forget(profiles)
            continue
        # as many rows as the block has different terms
        counts = _document_counts(profiles, len(vocabulary)).select("term", weight(F.lit(stats.docs), F.col("df")).alias("w"))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counts.collect():
            weights[r.term] = r.w
        asked = [(i, np.array(sorted({vocabulary[w] for w in words}), np.int64)) for i, words in block]
        best = _best(profiles, asked, weights, stats, top, shard_postings)
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        best = stored(best.select("item_id", "rank", "doc_id", "score"), "best")
        forget(profiles)
        found = found.unionByName(best)
    return found
