"""Mixing sources to target weights by pivotal dependent rounding, as DataFrame operations only.

A source's target divided by its size gives every document of it the same expected number of copies.
The whole part is taken by all.  The fractional parts are rounded together: two documents meet, and
mass (words) moves from one to the other, at random but without changing any expectation, until one holds no
or a whole further copy; the other goes on to the next meeting.  So the words a source takes stay at its target.

The meetings form a reduction tree: blocks of a bounded number of documents each settle all but
one document, and the ones left over meet in the next level's blocks.  At the root one document per source
keeps a fraction, which is drawn with its probability.  So all copies are whole, and a source misses its target by
less than one document.

Wholly equal rows are one unit: what they take together is rounded like one document's fraction, and dealt out to them row by
row.

Defined results: a null or empty text has size 0 and never takes anything; a null source is a source
of its own, last in order; if all sizes are 0 every target is 0.  Blocks and draws follow from a hash of
a row's id, source and text, so reruns agree; among wholly equal rows it does not matter which one takes more.
Columns of the input travel in one struct, so no name can clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.tables import stored, word_count
from mediaweave.operators.ordered import global_rank, running_rank

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents that settle in one fold.
BLOCK = 256
#: Copies of one text that a task writes.
COPIES = 10_000
SEED = 8

_UNIT = "struct<key:bigint,rid:bigint,size:double,mass:double,draw:double>"
_DONE = "array<struct<rid:bigint,part:double>>"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to a table of (``source``, ``source_size``).

    Sources share all words by weight; a target stops at ``max_repeats`` times the source, and the
    excess is shared again by weight among the others until none is above.  Each round is one aggregate.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()])
    at = ((F.col("rank") - 1) % len(weights) + 1).cast("int")
    rows = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at),
            "limit": (F.col("source_size") * max_repeats).cast("double"),
        }
    )
    share = 0.0  # words per unit of weight
    while True:
        stopped = F.col("limit") < F.col("weight") * share
        found = rows.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(stopped, F.col("limit"))), F.lit(0.0))).alias("left"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("weight"),
        ).first()
        grown = found["left"] / found["weight"] if found["weight"] else share
        if grown <= share:
            break
        share = grown
    return rows.withColumn("target", F.least("limit", F.col("weight") * share)).drop("rank", "weight", "limit")


def _number(*parts) -> Column:
    """A random number in [0, 1) fixed by its arguments."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / float(1 << 52)


def _meeting(acc: Column, x: Column) -> Column:
    """Fold step: the document left over so far meets the next one, and one of them is settled."""
    a, b = acc.left, x
    to_b = F.least(a.mass, b.size - b.mass)
    to_a = F.least(b.mass, a.size - a.mass)
    towards_b = b.draw * (to_a + to_b) < to_a
    # what is settled: the giver at nothing if all of it fits, else the taker at a whole copy
    fits = F.when(towards_b, a.mass <= b.size - b.mass).otherwise(b.mass <= a.size - a.mass)
    a_settled = F.when(towards_b, fits).otherwise(~fits)

    def moved(u: Column, mass: Column) -> Column:
        fields = {"key": u.key, "rid": u.rid, "size": u.size, "mass": mass, "draw": u.draw}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    change = F.when(towards_b, to_b).otherwise(-to_a)
    left = F.when(a_settled, moved(b, b.mass + change)).otherwise(moved(a, a.mass - change))
    done = F.struct(
        F.when(a_settled, a.rid).otherwise(b.rid).alias("rid"), F.when(fits, 0.0).otherwise(1.0).alias("part")
    )
    return F.struct(left.alias("left"), F.concat(acc.done, F.array(done)).alias("done"))


def _settle(units: DataFrame, level: int, block: int) -> DataFrame:
    """Let the documents of a source meet in blocks of about ``block``: one is ``left`` of each."""
    n = F.ceil(F.col("n") / F.lit(block))
    draw = _number(F.lit(level), F.lit("draw"), "key").alias("draw")
    blocks = units.groupBy(
        "source", n.alias("n"), F.pmod(F.xxhash64(F.lit(level), F.lit("block"), "key"), n).alias("block")
    ).agg(F.array_sort(F.collect_list(F.struct("key", "rid", "size", "mass", draw).cast(_UNIT))).alias("u"))
    start = F.struct(F.element_at("u", 1).alias("left"), F.array().cast(_DONE).alias("done"))
    met = F.aggregate(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))), start, _meeting)
    return blocks.select("source", "n", met.alias("met")).select("source", "n", "met.left", "met.done")


def round_copies(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, part): the fraction of every document in ``rows`` (source, key, rid, size, part), rounded to 0 or 1."""
    counted = rows.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    largest = counted.agg(F.max("n")).first()[0] or 0
    units = rows.join(counted, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "n", "key", "rid", "size", (F.col("size") * F.col("part")).alias("mass")
    )
    done, level = [], 0
    while True:
        met = stored(_settle(units, level, block), f"level{level}")
        done.append(met.select(F.inline("done")))
        units = met.select("source", "n", "left.key", "left.rid", "left.size", "left.mass")
        level += 1
        if block**level >= largest:
            break
    drawn = _number(F.lit("root"), "key") < F.col("mass") / F.col("size")
    root = units.select("rid", F.when(drawn, 1.0).otherwise(0.0).alias("part"))
    return reduce(DataFrame.unionByName, done, root)


def further_copies(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, extra): further copies, 0 or 1, of every row of ``rows`` (source, key, rid, size, part); rows of one key are equal."""
    groups = rows.groupBy("source", "key", "size").agg(
        F.min("rid").alias("rid"), F.count("*").alias("rows"), (F.count("*") * F.first("part")).alias("wanted")
    )
    groups = stored(groups, "equal")
    fractions = groups.select("source", "key", "rid", "size", (F.col("wanted") - F.floor("wanted")).alias("part"))
    dealt = groups.join(round_copies(fractions, block), "rid").withColumn("extra", F.floor("wanted") + F.col("part").cast("bigint"))
    single = dealt.filter("rows = 1").select("rid", "extra")
    several = dealt.filter("rows > 1").select(F.col("source").alias("of"), "key", "size", "extra")
    several = rows.select("source", "key", "size", "rid").join(several, ["key", "size"]).filter(F.col("source").eqNullSafe(F.col("of")))
    # row numbers grow with the partition that gave them
    several = several.withColumn("name", F.xxhash64("source", "key", "size"))
    several = running_rank(several, ["name"], F.shiftright("rid", 33), ["rid"])
    several = several.select("rid", (F.col("rank") <= F.col("extra")).cast("bigint").alias("extra"))
    return single.unionByName(several)


def _names(columns: tuple[str, ...] | list[str]) -> list[Column]:
    """128 bits that tell rows with different columns apart."""
    return [F.xxhash64(F.lit(n), *columns).alias(c) for n, c in enumerate(("_one", "_two"))] if columns else []


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block: int = BLOCK,
    keep: list[str] | None = None,
    name: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """The rows of ``docs`` (or their columns ``keep``) as the struct ``row`` with size, source_size, target and
    ``taken`` words.  ``name`` asks for two hashes of these columns, to tell rows by."""
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if keep is None or c in keep]).alias("row"),
        F.col("source").cast("string").alias("source"),
        word_count("text").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
        *_names(name),
    )
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = stored(targets(sources, weights, max_repeats), "targets").withColumnRenamed("source", "of")
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"whole": F.floor(rate), "part": rate - F.floor(rate)})
    sized = rows.filter("size > 0").select("source", "key", "rid", F.col("size").cast("double").alias("size"), "part")
    out = rows.join(further_copies(sized, block), "rid", "left")
    taken = (F.col("whole") + F.coalesce("extra", F.lit(0))) * F.col("size")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"), *(["_one", "_two"] if name else []))


def mixed_documents(docs: DataFrame, most: int = COPIES) -> DataFrame:
    """Each document, whole, as often as the mix takes it.  Same columns as ``docs``.

    Texts of more than ``most`` copies are spread over tasks, ``most`` copies each.
    """
    # the texts wait in their table; rows are told by their hashes, and wholly equal rows are taken together
    out = mix(docs, keep=["doc_id"], name=docs.columns).filter("taken > 0")
    wanted = stored(out.groupBy("_one", "_two").agg(F.sum(F.expr("taken div size")).alias("copies")), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_names(docs.columns))

    def texts(of: DataFrame) -> DataFrame:
        return of.join(rows, ["_one", "_two"]).dropDuplicates(["_one", "_two"])

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(1).cast("bigint"), n))

    taken = texts(wanted.filter(F.col("copies") <= most)).select("row", each(F.col("copies")).alias("copy"))
    often = wanted.filter(F.col("copies") > most)
    if not often.isEmpty():
        piles = texts(often).select("_one", "row", "copies", each(F.ceil(F.col("copies") / most)).alias("pile"))
        piles = piles.repartition("_one", "pile")
        left = F.col("copies") - (F.col("pile") - 1) * most
        taken = taken.unionByName(piles.select("row", each(F.least(left, F.lit(most).cast("bigint"))).alias("copy")))
    return taken.select("row.*")
