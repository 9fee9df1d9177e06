"""Conversation prefix trie: which conversations share how many leading turns.

Every distinct sequence of first turns is a node; a conversation is a member of all nodes it starts with.  A node is
known by its depth and two 64-bit sums (exclusive or) over hashes of its turns and their places, so that running values in
a conversation give all its prefixes and a conversation of any length can be cut into slices.  The smallest member of a node
and its depth name it.  Leaves and saved tokens of subtrees are rolled up by centroid decomposition (``centroids``).

Defined results: rows without a conv_id are ignored; null role and text are empty; rows of one turn are ordered by role
and text, and repeated rows are turns of their own; a table without conversations has no nodes, not even the root.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaweave.llm.centroids import LIMIT, rollup
from mediaweave.llm.tables import forget, stored
from mediaweave.operators.ordered import SLICE, running_rank, slices

#: Turns of a conversation that one task works on.
SLICE_ROWS = 1_000_000
#: Most turns that a conversation can take over from another one.
MOST_SHARED = 8
_KEY = ["depth", "k1", "k2"]


def _shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def ordered_turns(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Turns with their place (from 1) in their conversation: conv_id, place, two hashes of role and text, bytes of the text."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "text"]
    ranked = running_rank(slices(rows, order, slice_rows), ["conv_id"], F.col(SLICE), order[1:], "place")
    return ranked.select(
        "conv_id",
        F.col("place").cast("bigint").alias("place"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "role", "text").alias("h2"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and turns (conv_id, depth, n_turns, h1, h2, bytes) after the rebuilding.

    A conversation starts with the first turns of the first of its five and goes on with its own from there.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    sizes = sizes.withColumn("lead", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", _shared_turns(F.col("conv_id")))
    leads = sizes.select(F.col("conv_id").alias("lead"), F.col("own").alias("lead_own"))
    convs = sizes.join(leads, "lead", "left")
    convs = convs.withColumn("shared", F.least("h", F.coalesce("lead_own", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "lead", "h", "shared", "n_turns"), "conversations")
    of = convs.select(F.col("conv_id").alias("to"), F.col("lead").alias("conv_id"), "h", "n_turns")
    heads = turns.filter(F.col("place") <= MOST_SHARED).join(of, "conv_id").filter("place <= h")
    heads = heads.select(F.col("to").alias("conv_id"), F.col("place").alias("depth"), "n_turns", "h1", "h2", "bytes")
    tails = turns.join(convs, "conv_id").filter("place > h")
    tails = tails.select("conv_id", (F.col("shared") + F.col("place") - F.col("h")).alias("depth"), "n_turns", "h1", "h2", "bytes")
    return convs, heads.unionByName(tails)


def prefixes(turns: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every conversation's prefixes: conv_id, depth, n_turns, bytes of the last turn, key (k1, k2) and parent's key (p1, p2)."""
    rows = turns.withColumns({"t1": F.xxhash64("h1", "depth"), "t2": F.xxhash64("h2", "depth")})
    rows = rows.withColumn("slice", F.floor(F.col("depth") / slice_rows))
    w = W.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"k1": F.bit_xor("t1").over(w), "k2": F.bit_xor("t2").over(w)})
    # only conversations of several slices carry something from one to the next
    long = turns.filter(F.col("n_turns") >= slice_rows).withColumn("slice", F.floor(F.col("depth") / slice_rows))
    sums = long.groupBy("conv_id", "slice").agg(
        F.bit_xor(F.xxhash64("h1", "depth")).alias("s1"), F.bit_xor(F.xxhash64("h2", "depth")).alias("s2")
    )
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "slice", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2"))
    rows = rows.join(sums, ["conv_id", "slice"], "left")

    def total(k, b):
        return F.col(k).bitwiseXOR(F.coalesce(F.col(b), F.lit(0).cast("bigint")))

    rows = rows.withColumns({"k1": total("k1", "b1"), "k2": total("k2", "b2")})
    return rows.select(
        "conv_id", "depth", "n_turns", "bytes", "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"),
    )


def id_digests(rows: DataFrame, key: list[str], piece: int = 4096) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ``conv_id`` of each key.

    Sorted runs become pieces of text first, so a group of any size reaches its one task as few rows, which are
    hashed as they come.
    """
    n = len(key)
    names = [*key, "first", "ids"]

    def pieces(batches):
        held, ids = None, []

        def packed():
            columns = [pa.array([v], pa.int64()) for v in (*held, ids[0])] + [pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for *k, i in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (k != held or len(ids) == piece):
                    yield packed()
                    ids = []
                held = k
                ids.append(i)
        if ids:
            yield packed()

    def digests(batches):
        held, sha, out = None, None, []

        def packed():
            columns = [pa.array(c, pa.int64()) for c in list(zip(*out))[:n]] + [pa.array([o[n] for o in out])]
            return pa.RecordBatch.from_arrays(columns, names=[*key, "digest"])

        for batch in batches:
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != held:
                    if sha:
                        out.append((*held, sha.hexdigest()))
                    held, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if len(out) > 10_000:
                yield packed()
                out = []
        if sha:
            out.append((*held, sha.hexdigest()))
        if out:
            yield packed()

    kinds = ", ".join(f"{k} long" for k in key)
    runs = rows.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    parts = runs.mapInArrow(pieces, f"{kinds}, first long, ids string")
    whole = parts.repartition(*key).sortWithinPartitions(*key, "first")
    return whole.mapInArrow(digests, f"{kinds}, digest string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, see the module: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that a shared turn need not be stored or trained on again, over the subtree), ends_sha256."""
    turns = stored(ordered_turns(conversations, slice_rows), "turns")
    convs, rows = rebuilt(turns)
    rows = stored(prefixes(rows, slice_rows), "prefixes")
    top = convs.agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("n_turns") + 1).alias("weight"),
        F.sum((F.col("n_turns") == 0).cast("bigint")).alias("n_ends"),
    ).first()
    zero = F.lit(0).cast("bigint")
    nodes = rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"),
    )
    root = conversations.sparkSession.range(1 if top.n_convs else 0).select(
        *(zero.alias(k) for k in _KEY), F.lit(top.conv_id).cast("bigint").alias("conv_id"), F.lit(top.n_convs).cast("bigint").alias("n_convs"),
        zero.alias("bytes"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"),
        F.lit(top.weight).cast("bigint").alias("weight"),
    )
    nodes = stored(nodes.unionByName(root), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    tree = nodes.join(parents, ["depth", "p1", "p2"], "left").join(children.agg(F.count("*").alias("n_children")), _KEY, "left")
    tree = tree.withColumn("n_children", F.coalesce("n_children", zero))
    ends = rows.filter("depth = n_turns").select(*_KEY, "conv_id")
    ends = ends.unionByName(convs.filter("n_turns = 0").select(*(zero.alias(k) for k in _KEY), "conv_id"))
    tree = tree.join(id_digests(ends, _KEY), _KEY, "left")
    tree = stored(
        tree.select(
            *_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "weight",
            (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "tree",
    )

    def paths() -> DataFrame:
        # a conversation names the nodes below the last one it shares with a smaller one, if there are any
        chains = tree.select(F.col("conv_id").alias("of")).distinct()
        named = tree.select(*_KEY, F.col("conv_id").alias("chain"), F.col("parent_conv_id").alias("parent_chain"))
        found = rows.select(F.col("conv_id").alias("of"), *_KEY).join(chains, "of", "left_semi").join(named, _KEY)
        starts = chains.select("of", zero.alias("depth"), F.lit(top.conv_id).cast("bigint"), F.lit(None).cast("bigint"))
        return stored(found.select("of", "depth", "chain", "parent_chain").union(starts), "paths")

    forest = tree.select(
        F.col("conv_id").alias("chain"), "depth", F.col("parent_conv_id").alias("parent_chain"), "weight",
        F.lit(top.conv_id).cast("bigint").alias("root_chain"), F.lit(top.weight).cast("bigint").alias("root_weight"),
        "n_leaves", "saved_tokens",
    )
    sums = rollup(forest, paths, ["n_leaves", "saved_tokens"], limit)
    out = tree.drop("n_leaves", "saved_tokens", "weight", "k1", "k2").join(
        sums.withColumnRenamed("chain", "conv_id"), ["conv_id", "depth"]
    )
    out = stored(
        out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie"
    )
    forget(turns, convs, rows, nodes, tree)
    return out
