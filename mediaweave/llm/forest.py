"""An LSH forest as sorted signature orders: labels, neighbours by longest common prefix, and regions of the least depth.

A tree is a sequence of minhashes of its own.  An item's label in it packs this path so that the order of labels is the
order of a prefix tree: 40 bits for the first ``depth`` minhashes, which stand together as no region is wider, then 12
bits for each of ``DEEPER`` further ones.  The number of steps that two labels share is read from their bits.  Equal bits of
unlike paths cost a comparison, not a result.

All (tree, label, item) are sorted over the cluster.  Items whose labels share the first step with a neighbour in this
order are in a region; the neighbour with the longest common prefix in any tree is an item's candidate.  The item is
part of the sort key, so that one label that very many items share is dealt over many partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.llm import sketches
from mediaweave.llm.tables import forget, stored

#: Minhashes below the least depth, and bits of a label for each.
DEEPER = 2
STEP_BITS = 12
#: Bits of a label that a region leaves out, from the least depth to the largest.
SHIFTS = tuple(STEP_BITS * k for k in range(DEEPER, -1, -1))


def labels(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Per row the label of each tree, of minhashes ``depth + DEEPER`` to a tree."""
    n, total = hashes.shape
    width = depth + DEEPER
    paths = hashes[:, : total // width * width].reshape(n, total // width, width)
    top = sketches.path_keys(np.ascontiguousarray(paths[:, :, :depth]).reshape(n, -1), depth).view(np.uint64)
    out = top >> np.uint64(SHIFTS[0]) << np.uint64(SHIFTS[0])
    for j, shift in enumerate(SHIFTS[1:], depth):
        step = sketches.mixed(paths[:, :, j].astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - STEP_BITS)
        out |= step << np.uint64(shift)
    return out.view(np.int64)


def _shared(one: Column, two: Column, shifts: tuple[int, ...]) -> Column:
    """Steps that two labels of a tree have in common, null for none."""
    found = F.lit(None).cast("int")
    for steps, shift in enumerate(shifts, 1):
        found = F.when(F.shiftright(one, shift) == F.shiftright(two, shift), steps).otherwise(found)
    return found


def _sorted(rows: DataFrame, shifts: tuple[int, ...], order: tuple[str, ...] = ("tree", "key", "item")) -> DataFrame:
    """(tree, key, item, before, steps, shared, first, last): all labels (tree, key, item) in sorted order, but for those that share nothing.

    ``before`` is the item before, if it shares ``steps``; ``shared`` tells whether it or the next one does;
    ``first`` and ``last`` mark the edges of a partition, which stay in any case.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def chosen(columns: list[np.ndarray], after: np.ndarray, begins: bool, ends: bool) -> pa.RecordBatch:
        tree, key, item, before, steps = columns
        first, last = np.zeros(len(item), bool), np.zeros(len(item), bool)
        first[:1], last[-1:] = begins, ends
        shared = (steps > 0) | (after > 0)
        none = steps == 0
        found = [pa.array(tree), pa.array(key), pa.array(item), pa.array(before, mask=none), pa.array(steps, mask=none)]
        flags = [pa.array(shared), pa.array(first), pa.array(last)]
        names = ["tree", "key", "item", "before", "steps", "shared", "first", "last"]
        return pa.RecordBatch.from_arrays(found + flags, names=names).filter(pa.array(shared | first | last))

    def run(batches):
        held, begins = None, True  # the last row so far, which waits for the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, key, item = (batch.column(c).to_numpy() for c in range(3))
            if held is not None:
                tree, key, item = (np.concatenate((h, c)) for h, c in zip(held, (tree, key, item)))
            before, steps = np.concatenate((item[:1], item[:-1])), np.zeros(len(item), np.int32)
            for shift in shifts:
                steps[1:] += (tree[1:] == tree[:-1]) & (key[1:] >> shift == key[:-1] >> shift)
            if held is not None:
                before[0], steps[0] = held[3][0], held[4][0]
            columns = [tree, key, item, before, steps]
            if len(item) > 1:
                yield chosen([c[:-1] for c in columns], steps[1:], begins, False)
                begins = False
            held = [c[-1:] for c in columns]
        if held is not None:
            yield chosen(held, np.zeros(1, np.int32), begins, True)

    kind = "tree int, key long, item long, before long, steps int, shared boolean, first boolean, last boolean"
    return stored(rows.mapInArrow(run, kind), "sorted")


def _across_edges(found: DataFrame, shifts: tuple[int, ...]) -> DataFrame:
    """(tree, key, item, before, steps) of the rows that share a step with a neighbour, in whatever partition."""
    # two rows of a partition at most: the neighbours of these are the edges of other partitions
    edges = found.filter("first OR last")
    along = Window.partitionBy("tree").orderBy("key", "item")
    edges = edges.withColumns(
        {
            "ahead": F.lag("item").over(along),
            "steps_ahead": F.when(F.col("first"), _shared(F.col("key"), F.lag("key").over(along), shifts)),
            "steps_after": F.when(F.col("last"), _shared(F.col("key"), F.lead("key").over(along), shifts)),
        }
    )
    crossed = F.col("steps_ahead").isNotNull()
    edges = edges.filter(F.col("shared") | crossed | F.col("steps_after").isNotNull()).select(
        "tree", "key", "item",
        F.when(crossed, F.col("ahead")).otherwise(F.col("before")).alias("before"),
        F.coalesce("steps_ahead", "steps").alias("steps"),
    )
    inner = found.filter("shared AND NOT first AND NOT last").select("tree", "key", "item", "before", "steps")
    return inner.unionByName(edges)


def _regions(rows: DataFrame, shift: int) -> DataFrame:
    """(tree, key, item, leader) of the rows that share a step, with whole labels as keys.

    The leader of a region at the least depth is the item that is least once its bits are flipped by a pattern of the
    tree's own: drawn by chance, and found by a plain minimum.
    """
    pattern = F.xxhash64("tree")
    region = F.shiftright("key", shift)
    lead = rows.groupBy("tree", region.alias("region")).agg(F.min(F.col("item").bitwiseXOR(pattern)).alias("least"))
    named = rows.withColumn("region", region).join(lead, ["tree", "region"])
    return stored(named.select("tree", "key", "item", F.col("least").bitwiseXOR(pattern).alias("leader")), "regions")


def shared_regions(rows: DataFrame) -> DataFrame:
    """(tree, key, item, leader) of the rows (tree, key, item) that have a key of a tree in common with another item.

    Keys begin with their tree, so that the first column sorted by tells nearly all rows apart.
    Most keys are an item's alone.  They are sorted once and left out where they stand, without a second shuffle of all keys.
    """
    found = _sorted(rows, (0,), ("key", "item"))
    out = _regions(_across_edges(found, (0,)), 0)
    forget(found)
    return out


def regions_and_neighbours(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions (tree, key, item, leader), and for every item of them its neighbour (a, b) with the longest common prefix."""
    labelled = items.select("item", F.posexplode("keys").alias("tree", "key")).select("tree", "key", "item")
    found = _sorted(labelled, SHIFTS)
    rows = _across_edges(found, SHIFTS)
    regions = _regions(rows, SHIFTS[0])
    pairs = rows.filter("before IS NOT NULL").select(F.col("item").alias("a"), F.col("before").alias("b"), "steps")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "steps"))
    nearest = stored(pairs.groupBy("a").agg(F.max_by("b", F.struct("steps", "b")).alias("b")), "nearest")
    forget(found)
    return regions, nearest
