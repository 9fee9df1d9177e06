"""Near-duplicate documents by an LSH forest of minhash signatures over word shingles.

Documents with equal shingle sets are one item from the start.  A tree is a signature of minhashes of its own, and all
items are sorted by it (``forest``).  Candidates are an item's neighbour with the longest common prefix in any order,
and the leaders of its regions: the items that share the first ``depth`` minhashes of a tree with it.  What these do not
connect is compared within regions (``linking``).  A region's depth is its own: one that is crowded with unlike
documents is cut by the next minhash, and by one more, while regions of copies stay whole; what is crowded at the largest
depth is compared block by block.  Links are confirmed on full shingle sets.

The least depth follows from the number of documents, so that unlike ones seldom meet, and the number of trees from both
depths: a pair at the wanted similarity shares no region with a chance of ``MISS``, and with ``MISS_DEEP`` if all the regions
it could share are crowded and cut to the largest depth.

Defined results: a document without words, or without an id, has no shingles to share: it is linked with
nothing; fewer words than a shingle are one shingle; repeated rows are copies like any others, and of several
rows with the id of the component each is marked as kept.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm import forest, sketches
from mediaweave.llm.linking import BLOCK, linked
from mediaweave.llm.tables import forget, stored


#: Chance that a pair at the wanted similarity shares no region.
MISS = 1e-5
#: The same if every region is cut to the largest depth.
MISS_DEEP = 1e-3
#: Similarity of unlike documents that a region's depth is made for.
BACKGROUND = 0.03


def forest_shape(n_docs: int, percent: int) -> tuple[int, int]:
    """(least depth, trees) for this many documents."""
    depth = max(3, math.ceil(math.log(max(n_docs, 2)) / -math.log(BACKGROUND)))
    chances = ((MISS, depth), (MISS_DEEP, depth + forest.DEEPER))
    return depth, max(math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** d)) for miss, d in chances)


def profiles(docs: DataFrame, words: int, depth: int, trees: int) -> DataFrame:
    """doc_id, text_hash, size of the set, fingerprint (f1, f2), labels in the trees and a byte per minhash."""
    factors = sketches.multipliers((depth + forest.DEEPER) * trees)

    def run(batches):
        memo = sketches.WordHashes()
        for batch in batches:
            ids = batch.column(0)
            for first, sets in sketches.batches_of(batch.column(1).cast(pa.binary()), words, memo):
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if full:
                    hashes = sketches.minhashes([sets[i] for i in full], factors)
                    for i, k, s in zip(full, forest.labels(hashes, depth).tolist(), hashes.astype(np.uint8)):
                        keys[i], sketch[i] = k, s.tobytes()
                prints = [sketches.fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sets)),
                        batch.column(2).slice(first, len(sets)),
                        pa.array(list(map(len, sets)), pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sketch, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "size", "f1", "f2", "keys", "sketch"],
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")
    )
    kind = "doc_id long, text_hash long, size long, f1 long, f2 long, keys array<long>, sketch binary"
    return rows.mapInArrow(run, kind)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(item, set) of the wanted items (item, doc_id, f1, f2)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row that is there several times is read once
    rows = wanted.join(rows, "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "item", "h"])
    rows = rows.select("item", "f1", "f2", "text")

    def run(batches):
        memo = sketches.WordHashes()
        for batch in batches:
            items, f1, f2 = (batch.column(i).to_pylist() for i in range(3))
            for first, sets in sketches.batches_of(batch.column(3).cast(pa.binary()), words, memo):
                # rows of a repeated id may hold other texts than the wanted one
                at = [i for i, s in enumerate(sets, first) if (f1[i], f2[i]) == sketches.fingerprint(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([items[i] for i in at], pa.int64()), pa.array([sets[i - first].tobytes() for i in at], pa.binary())],
                    names=["item", "set"],
                )

    return rows.mapInArrow(run, "item long, set binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (``doc_id``, ``text``), with the component's
    own name and the hash of the text.  A region of more than ``block`` * ``block`` unlike pairs is crowded."""
    depth, trees = forest_shape(docs.count(), percent)
    rows = profiles(docs, words, depth, trees).withColumn("rid", F.monotonically_increasing_id())
    rows = stored(rows, "profiles")
    usable = rows.filter("size > 0 AND doc_id IS NOT NULL")
    # equal sets are one item, named by one of their rows
    classes = usable.groupBy("f1", "f2").agg(F.min("rid").alias("item"))
    members = usable.select("rid", "f1", "f2").join(classes, ["f1", "f2"]).select("rid", "item")
    members = stored(members, "members")
    heads = members.filter("rid = item").select("item")
    items = stored(rows.join(heads, F.col("rid") == F.col("item")).select("item", "doc_id", "size", "f1", "f2", "keys", "sketch"), "items")
    regions, nearest = forest.regions_and_neighbours(items)
    wanted = items.join(regions.select("item").distinct(), "item", "left_semi").select("item", "doc_id", "f1", "f2")
    sets = stored(_sets(docs, wanted, words), "sets")
    linked_items = linked(items, regions, sets, percent, block, forest.SHIFTS, nearest)
    found = linked_items.toDF("of", "component")
    named = members.join(found, F.col("item") == F.col("of"), "left")
    named = named.select("rid", F.coalesce("component", "item").alias("component"))
    placed = rows.select("rid", "doc_id", "text_hash", F.col("size").alias("n_shingles")).join(named, "rid", "left")
    placed = stored(placed.select("doc_id", "text_hash", "n_shingles", "component"), "placed")
    forget(rows, members, items, regions, nearest, sets, linked_items)
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "component", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "component", "text_hash")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id; same columns as ``docs``.

    If several rows of a group have this id, the one with the least hash of its text stays; rows that share an id
    but no group all stay, and so do rows without an id.
    """
    kept = near_duplicates(docs, words, percent).filter("kept AND doc_id IS NOT NULL")
    kept = kept.groupBy(F.col("doc_id").alias("_id"), "component").agg(F.min("text_hash").alias("_hash"))
    kept = kept.select("_id", "_hash").distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash")
    )
    one = rows.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    every = one.select("row").unionByName(rows.filter("_id IS NULL").select("row"))
    return every.select([F.col("row")[c].alias(c) for c in docs.columns])
