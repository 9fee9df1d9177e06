"""From candidate regions to components of verified links, without collecting a region or a component.

Input are items (``item``, ``size``, ``sketch``, ``keys``), every one a member of a region per tree: those with the
same entry of ``keys`` at the same place.  Two items are compared if they share a region, if their sizes allow
the wanted similarity and their sketches do not rule it out; a link is confirmed on the full sets.

1. Every item meets the leaders of its regions; the best-looking one is verified.  Groups of copies become
   one component this way at the cost of one comparison per item, however large they are.
2. Regions that still hold several components are compared within, crowded ones cut by longer keys first where the
   caller's keys allow it, and then by the rarest shingles of their items (``_split``): the items outside a region's main component against all of it, block by block.  Sketches tell which items of a block are worth their full sets; those
   go to the block once, whatever number of pairs they stand in.  Pairs inside one component need no comparison, as
   they cannot change the result, and a block reports no more links than connect its components.

So every pair of a region whose sketch allows the similarity is either verified or already connected: the
components are those of all links found, and no group is ever spread into its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm import sketches
from mediaweave.llm.tables import forget, stored


#: Members of a region, and outsiders, that one task compares at a time.
BLOCK = 512
#: A shingle is common in a region if more than this part of the members hold it.
COMMON = 1 / 32
#: Members of a region whose shingles one task counts at a time.
SLICE = 2048


def components(links: DataFrame) -> DataFrame:
    """(item, component) of the linked items: the smallest item reachable, by alternating star contractions."""
    def larger_first(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = stored(larger_first(links), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours of every item move to the least of its neighbourhood
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = larger_first(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, stored(larger_first(moved.unionByName(small.select("a", F.col("m").alias("b")))), "links")
        forget(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    heads = edges.select(F.col("b").alias("item"), F.col("b").alias("component")).distinct()
    out = stored(edges.select(F.col("a").alias("item"), F.col("b").alias("component")).unionByName(heads), "components")
    forget(edges)
    return out


def _estimated(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow, with their estimate ``like``."""
    side = items.select("item", "size", "sketch")
    one = side.toDF("a", "size_a", "sketch_a")
    two = side.toDF("b", "size_b", "sketch_b")
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    rows = pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b", "sketch_a", "sketch_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.array([np.frombuffer(v, np.uint8) for v in batch.column(c).to_pylist()]) for c in (2, 3))
            like = sketches.estimates(x, y)
            keep = like >= sketches.floor_of(percent, x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(like)], names=["a", "b", "like"]
            ).filter(pa.array(keep))

    return rows.mapInArrow(run, "a long, b long, like double")


def _best(pairs: DataFrame) -> DataFrame:
    """The best-looking partner of every ``a``."""
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    rows = pairs.select("a", "b").join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x, y = (
                    [np.frombuffer(v, np.uint64) for v in part.column(c).to_pylist()] for c in ("set_a", "set_b")
                )
                keep = [sketches.alike(p, q, percent) for p, q in zip(x, y)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return stored(rows.mapInArrow(run, "a long, b long"), "verified")


def _shapes(rows: DataFrame) -> DataFrame:
    """(tree, key, top, n, kinds) of the regions with several components; ``top`` is the largest."""
    parts = rows.groupBy("tree", "key", "component").agg(F.count("*").alias("n"))
    shapes = parts.groupBy("tree", "key").agg(
        F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")
    )
    return shapes.filter("kinds > 1")


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(tree, key, item, component) of the rows (..., common, set) for each shingle of a set's prefix, which is part of the key.

    A prefix holds the first ``n_prefix`` shingles in the order of the region: those that are not common by value, then the common ones.
    """
    def run(batches):
        for batch in batches:
            many, names = [], []
            for key, common, data in zip(*(batch.column(c).to_pylist() for c in ("key", "common", "set"))):
                found = np.frombuffer(data, np.uint64)
                common = np.array(common or [], np.int64).view(np.uint64)  # the most common one last
                rare = found[~np.isin(found, common)] if len(common) else found
                prefix = np.concatenate((rare, common[np.isin(common, found)]))[: n_prefix(len(found), percent)]
                many.append(len(prefix))
                names.append(sketches.mixed(sketches.mixed(prefix) + np.array([key], np.int64).view(np.uint64)).view(np.int64))
            if many:
                each = np.repeat(np.arange(len(many)), many)
                columns = [batch.column(c).take(pa.array(each)) for c in ("tree", "item", "component")]
                columns.insert(1, pa.array(np.concatenate(names)))
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "key", "item", "component"])

    rows = rows.select("tree", "key", "item", "component", "common", "set")
    return rows.mapInArrow(run, "tree int, key long, item long, component long")


def n_prefix(size: int, percent: int) -> int:
    """Two alike sets, of which one has ``size`` shingles, have one in common among the first so many of either, in any order of all shingles."""
    return size + (-size * percent) // 100 + 1


def _split(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, key, item, component) with crowded regions split by prefixes, and the tables this reads.

    Alike sets have a shingle in common among the first few of either, whatever the order of shingles is.  With common ones
    last, members that share no more than a region's common passage part, and no alike pair does.  A region
    is split where its blocks would take more rows than the prefixes of its members.
    """
    # none but regions of more than a block can be crowded
    large = rows.groupBy("tree", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("tree", "key")
    full = _shapes(rows.join(large, ["tree", "key"], "left_semi")).select("tree", "key", "n", (F.col("n") - F.col("top.n")).alias("outside"))
    full = stored(full.filter(F.col("n") * F.col("outside") > block * block), "full")
    if full.isEmpty():
        return rows, [full]
    inside = rows.join(full, ["tree", "key"]).join(sets.toDF("_item", "set"), F.col("item") == F.col("_item")).drop("_item")
    inside = stored(inside, "inside")
    size = F.length("set") / 8
    prefix = size - F.ceil(size * percent / 100) + 1
    worth = inside.groupBy("tree", "key", "n", "outside").agg(F.sum(prefix).alias("prefixes"))
    worth = worth.filter(2 * F.col("n") * F.col("outside") > block * F.col("prefixes")).select("tree", "key")
    worth = stored(worth, "worth")
    inside_split = inside.join(worth, ["tree", "key"])

    def common(batches):
        for held in _blocks(batches, ["tree", "key", "slice", "n", "set"]):
            shingle, many = np.unique(np.concatenate([np.frombuffer(r[4], np.int64) for r in held]), return_counts=True)
            often = many > COMMON * len(held)
            shingle, many = shingle[often], many[often]
            columns = [np.full(len(many), held[0][0], np.int32), np.full(len(many), held[0][1], np.int64), shingle, many]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "key", "shingle", "held"])

    # what is common in a region is common in a slice of it
    place = ["tree", "key", "slice", "n"]
    sliced = inside_split.withColumn("slice", F.pmod(F.xxhash64("item", F.lit("slice")), F.ceil(F.col("n") / SLICE))).select(*place, "set")
    found = sliced.repartition(*place).sortWithinPartitions(*place).mapInArrow(common, "tree int, key long, shingle long, held long")
    found = found.groupBy("tree", "key", "shingle").agg(F.sum("held").alias("held"))
    found = found.groupBy("tree", "key").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("common"))
    found = stored(found.select("tree", "key", F.col("common.shingle").alias("common")), "common")
    parts = stored(_prefixes(inside_split.join(found, ["tree", "key"], "left"), percent), "parts")
    forget(found, inside, full)
    return rows.join(worth, ["tree", "key"], "left_anti").select(parts.columns).unionByName(parts), [worth, parts]


def _at_depth(regions: DataFrame, found: DataFrame, block: int, shifts: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, key, item, component) with every region as deep as it must be, and the tables this reads: the last is empty if none is crowded.

    Regions begin with all but the last ``shifts[0]`` bits of their keys.  Those with more than ``block`` * ``block`` pairs of
    different components, of which one is outside the main one, go by the next number of bits.  Groups of copies are one component by
    now: they make no region deeper.
    """
    named = found.toDF("_item", "_component")
    rows = regions.join(named, F.col("item") == F.col("_item"), "left")
    rows = rows.select(
        "tree", F.shiftright("key", shifts[0]).alias("key"), F.col("key").alias("whole"), "item", F.coalesce("_component", "item").alias("component")
    )
    rows = stored(rows, "at_depth")
    tables = [rows]
    for shift in shifts[1:]:
        crowded = _shapes(rows).filter(F.col("n") * (F.col("n") - F.col("top.n")) > block * block)
        crowded = stored(crowded.select("tree", "key", F.lit(True).alias("crowded")), "crowded")
        tables.append(crowded)
        if crowded.isEmpty():
            break
        deeper = F.when(F.col("crowded"), F.shiftright("whole", shift)).otherwise(F.col("key"))
        rows = rows.join(crowded, ["tree", "key"], "left").select("tree", deeper.alias("key"), "whole", "item", "component")
    return rows.drop("whole"), tables


def _torn(rows: DataFrame, block: int) -> DataFrame:
    """Members of regions with several components, dealt into blocks.

    A region's main component is its largest.  Its members go to a block each; the items outside the main
    component also visit, in chunks, every block.  Rows say whether the item lives ``here`` and whether it ``visits``.
    """
    torn = _shapes(rows).select(
        "tree",
        "key",
        "top.main",
        F.ceil(F.col("n") / block).alias("blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / block).alias("chunks"),
    )
    rows = rows.join(torn, ["tree", "key"]).withColumn("outside", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("item"), F.col("blocks"))
    chunk = F.pmod(F.xxhash64("item", F.lit("chunk")), F.col("chunks"))

    def each(n):
        return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)

    def place(b, c):
        return F.struct(b.cast("bigint").alias("block"), c.cast("bigint").alias("chunk"))

    home = F.transform(each("chunks"), lambda c: place(own, c))
    visits = F.when(F.col("outside"), F.transform(each("blocks"), lambda b: place(b, chunk)))
    to = F.array_distinct(F.concat(home, F.coalesce(visits, F.array().cast("array<struct<block:bigint,chunk:bigint>>"))))
    rows = rows.select("tree", "key", "item", "component", "outside", own.alias("own"), chunk.alias("own_chunk"), F.explode(to).alias("to"))
    return rows.select(
        "tree", "key", "to.block", "to.chunk", "item", "component", "outside",
        (F.col("own") == F.col("to.block")).alias("here"),
        (F.col("outside") & (F.col("own_chunk") == F.col("to.chunk"))).alias("visits"),
    )


_PLACE = ["tree", "key", "block", "chunk"]
_PLACED = "tree int, key long, block long, chunk long, item long, component long, outside boolean, here boolean, visits boolean"


def _blocks(batches, columns):
    """Rows of one block at a time, from rows sorted by block."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and held[0][:4] != row[:4]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _allowed(rows: list[tuple], percent: int):
    """(visitor, member, estimate) by place in ``rows``: pairs of different components that sizes and sketches allow.

    A pair is left to an earlier tree if its whole keys are equal there, as it then shares a region of any depth."""
    tree = rows[0][0]
    item, component, size = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 9))
    outside, here, visits = (np.array([r[i] for r in rows], bool) for i in (6, 7, 8))
    sketch = np.array([np.frombuffer(r[10], np.uint8) for r in rows])
    keys = np.array([r[11] for r in rows], np.int64)
    low = sketches.floor_of(percent, sketch.shape[1])
    at_home, guests = np.flatnonzero(here), np.flatnonzero(visits)
    ok = component[guests][:, None] != component[at_home][None, :]
    ok &= np.minimum(size[guests][:, None], size[at_home]) * 100 >= np.maximum(size[guests][:, None], size[at_home]) * percent
    # of two outsiders, the larger one asks
    ok &= ~outside[at_home][None, :] | (item[guests][:, None] > item[at_home][None, :])
    x, y = np.nonzero(ok)
    out = []
    for cut in range(0, len(x), 50_000):
        i, j = guests[x[cut : cut + 50_000]], at_home[y[cut : cut + 50_000]]
        like = sketches.estimates(sketch[i], sketch[j])
        keep = like >= low
        i, j, like = i[keep], j[keep], like[keep]
        keep = ~(keys[i][:, :tree] == keys[j][:, :tree]).any(axis=1)
        out.append((i[keep], j[keep], like[keep]))
    none = np.zeros(0, np.int64)
    return [np.concatenate([o[k] for o in out]) if out else none for k in range(3)]


def _connecting(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Verified links that connect the components of a block, the best-looking pairs first."""
    i, j, like = _allowed(rows, percent)
    sets = [np.frombuffer(r[12], np.uint64) for r in rows]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for k in np.argsort(-like, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        one, two = find(rows[a][5]), find(rows[b][5])
        if one != two and sketches.alike(sets[a], sets[b], percent):
            parent[one] = two
            out.append((rows[a][4], rows[b][4]))
    return out


def _between(
    regions: DataFrame, items: DataFrame, sets: DataFrame, found: DataFrame, percent: int, block: int, shifts: tuple[int, ...]
) -> DataFrame:
    """Verified links (a, b) that connect different components of a region."""
    looks = items.select("item", "size", "sketch", "keys")
    columns = [*_PLACE, "item", "component", "outside", "here", "visits", "size", "sketch", "keys"]

    def dealt(rows: DataFrame, names: list[str]) -> DataFrame:
        return rows.select(names).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "item")

    def worth(batches):
        for rows in _blocks(batches, columns):
            i, j, _ = _allowed(rows, percent)
            chosen = [rows[k][:9] for k in np.union1d(i, j).tolist()]
            if chosen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*chosen), [pa.int32()] + [pa.int64()] * 5 + [pa.bool_()] * 3)],
                    names=columns[:9],
                )

    def connect(batches):
        for rows in _blocks(batches, [*columns, "set"]):
            links = _connecting(rows, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    rows, tables = _at_depth(regions, found, block, shifts)
    if not tables[-1].isEmpty():
        rows, more = _split(rows, sets.select("item", "set"), percent, block)
        tables += more
    torn = _torn(rows, block).join(looks, "item")
    chosen = stored(dealt(torn, columns).mapInArrow(worth, _PLACED), "chosen")
    full = chosen.join(looks, "item").join(sets.select("item", "set"), "item")
    out = stored(dealt(full, [*columns, "set"]).mapInArrow(connect, "a long, b long"), "between")
    forget(chosen, *tables)
    return out


def linked(
    items: DataFrame,
    regions: DataFrame,
    sets: DataFrame,
    percent: int,
    block: int = BLOCK,
    shifts: tuple[int, ...] = (0,),
    nearest: DataFrame | None = None,
) -> DataFrame:
    """(item, component) of all items with a link; ``sets`` has (item, set) for every item of the regions.

    A region is made of keys that are equal but for their last ``shifts[0]`` bits; where it is crowded with unlike items, fewer bits
    are left out.  ``nearest`` has further candidates (a, b), which are verified besides the leaders.
    """
    first = regions.filter("item <> leader").select(F.col("item").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = _best(_estimated(first, items, percent))
    if nearest is not None:
        pairs = pairs.unionByName(_estimated(nearest, items, percent).select("a", "b")).distinct()
    links = _verified(pairs, sets, percent)
    found = components(links)
    more = _between(regions, items, sets, found, percent, block, shifts)
    out = components(links.unionByName(more))
    forget(links, found, more)
    return out
