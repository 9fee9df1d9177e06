"""Subtree totals of a forest by centroid decomposition.

A component is cut at its centroid, the deepest node whose subtree holds at least half of the component's weight.
Everything below the cut is added up once, and the sum goes to every node on the path from the centroid to the top of
the component; then the parts are cut in turn.  An ancestor and its descendant are parted by exactly one cut, so each node
meets each of its descendants once, and weights halve with every cut: a path of a million nodes takes twenty
cuts, not a million steps.

Components above ``limit`` are cut by joins, all of them at once per round; a component within it is one bounded group
and is finished in a task.

A node is named (chain, depth).  ``paths`` has a row (of, depth, chain, parent_chain) for each node on the way from the
root to the nodes of the chain ``of``.  ``weight`` is the weight of a node's whole subtree, its own being at least 1.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.tables import forget, stored

#: Weight of a component that one task finishes.
LIMIT = 1 << 16

_COMP = ["comp_chain", "comp_depth"]


def _subtree_sums(parents: list[int], own: list[list[int]]) -> list[list[int]]:
    """Subtree sums of one tree, parents before children, by cutting at centroids (here of equal weights)."""
    out = [list(values) for values in own]
    waiting = [list(range(len(parents)))]
    place = [0] * len(parents)  # the part a node is in, as the number of its last cut
    cuts = 0
    while waiting:
        part = waiting.pop()
        if len(part) == 1:
            continue
        cuts += 1
        top = part[0]
        size = dict.fromkeys(part, 1)
        for v in reversed(part):
            if v != top:
                size[parents[v]] += size[v]
        half = len(part) / 2
        centre = next(v for v in reversed(part) if size[v] >= half)
        upper, lower, under = [], {}, {}
        for v in part:  # parents first
            if v == centre:
                continue
            up = parents[v] if v != top else -1
            if up == centre:
                under[v] = v
            elif up in under:
                under[v] = under[up]
            if v in under:
                lower.setdefault(under[v], []).append(v)
            else:
                upper.append(v)
        for k in range(len(own)):
            values = own[k]
            below = sum(values[v] for members in lower.values() for v in members)
            out[k][centre] += below
            below += values[centre]
            v = centre
            while v != top:
                v = parents[v]
                out[k][v] += below
        waiting += lower.values()
        if upper:
            waiting.append(upper)
    return out


def _finished(state: DataFrame, values: list[str]) -> DataFrame:
    """(chain, depth, values) of components within the limit, each in one task."""
    columns = [*_COMP, "depth", "chain", "parent_chain", *values, *(f"had_{v}" for v in values)]
    rows = state.select(columns).repartition(*_COMP).sortWithinPartitions(*_COMP, "depth")
    n = len(values)

    def of(group: list[tuple]):
        at = {(r[3], r[2]): i for i, r in enumerate(group)}
        parents = [at.get((r[4], r[2] - 1), -1) for r in group]
        sums = _subtree_sums(parents, [[r[5 + k] for r in group] for k in range(n)])
        return [r[3] for r in group], [r[2] for r in group], *([s + r[5 + n + k] for s, r in zip(sums[k], group)] for k in range(n))

    def run(batches):
        held: list[tuple] = []
        out: list[list] = [[] for _ in range(2 + n)]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    for have, more in zip(out, of(held)):
                        have.extend(more)
                    held = []
                held.append(row)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["chain", "depth", *values])
                out = [[] for _ in range(2 + n)]
        if held:
            for have, more in zip(out, of(held)):
                have.extend(more)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["chain", "depth", *values])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["chain", "depth", *values]))


def _cut(big: DataFrame, paths: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: every component of ``big`` loses its centroid.  Returns (centroids with their sums, the rest)."""
    halves = big.filter(F.col("weight") * 2 >= F.col("total"))
    centre = halves.groupBy(*_COMP).agg(F.max(F.struct("depth", "chain", "weight")).alias("c"))
    centre = centre.select(*_COMP, F.col("c.chain").alias("c_chain"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
    centre = stored(centre, "centroids")
    steps = paths.select(
        F.col("of").alias("chain"), (F.col("depth") - 1).alias("c_depth"), F.col("chain").alias("under"), F.col("parent_chain").alias("c_chain")
    )
    # the node one step below the centroid on a node's own path, if the path leads through it
    marked = big.join(centre, _COMP).join(steps, ["chain", "c_depth", "c_chain"], "left")
    marked = marked.withColumn("centre", (F.col("chain") == F.col("c_chain")) & (F.col("depth") == F.col("c_depth")))
    marked = marked.withColumn("below", F.col("under").isNotNull() & (F.col("depth") > F.col("c_depth")))
    marked = stored(marked, "marked")
    sums = marked.filter("centre OR below").groupBy(*_COMP).agg(*(F.sum(v).alias(f"sum_{v}") for v in values))
    above = centre.join(paths, F.col("c_chain") == F.col("of")).filter("depth <= c_depth AND depth >= comp_depth")
    above = above.select(*_COMP, "chain", "depth").join(sums, _COMP)
    above = stored(above.select("chain", "depth", *(f"sum_{v}" for v in values)), "above")
    rows = marked.join(above, ["chain", "depth"], "left")
    added = {f"had_{v}": F.col(f"had_{v}") + F.coalesce(f"sum_{v}", F.lit(0)) for v in values}
    rows = rows.withColumns(added)
    on_path = F.col(f"sum_{values[0]}").isNotNull()
    done = rows.filter("centre").select("chain", "depth", *(F.col(f"had_{v}").alias(v) for v in values))
    rest = rows.filter("NOT centre").select(
        "chain", "depth", "parent_chain",
        F.when(F.col("below"), F.col("under")).otherwise(F.col("comp_chain")).alias("comp_chain"),
        F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("comp_depth")).alias("comp_depth"),
        F.when(on_path, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"),
        *values, *added,
    )
    done, rest = stored(done, "cut"), stored(rest, "parts")
    totals = rest.groupBy(*_COMP).agg(F.max("weight").alias("total"))
    out = stored(rest.join(totals, _COMP), "components")
    forget(centre, marked, above, rest)
    return done, out


def rollup(nodes: DataFrame, paths: Callable[[], DataFrame], values: list[str], limit: int = LIMIT) -> DataFrame:
    """(chain, depth, values): the sums of ``values`` over each node's subtree, itself included.

    ``nodes`` has chain, depth, parent_chain, weight, chain and weight of its tree's root (root_chain, root_weight; at depth 0)
    and the values.  ``paths`` is asked for only if a component is above the limit.
    """
    big = nodes.select(
        "chain", "depth", "parent_chain", F.col("root_chain").alias("comp_chain"), F.lit(0).cast("bigint").alias("comp_depth"),
        "weight", F.col("root_weight").alias("total"), *values, *(F.lit(0).cast("bigint").alias(f"had_{v}") for v in values),
    )
    done, tables, steps = [], [], None
    while True:
        done.append(_finished(big.filter(F.col("total") <= limit), values))
        big = big.filter(F.col("total") > limit)
        if big.isEmpty():
            break
        if steps is None:
            steps = paths()
            tables.append(steps)
        cut, big = _cut(big, steps, values)
        done.append(cut)
        tables += [cut, big]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = stored(out, "sums")
    forget(*tables)
    return out
