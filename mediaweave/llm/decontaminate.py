"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of the items travels to the tasks; every document streams its words through it and
tracks the longest match.  A match that reaches a window marks its words as hit.  ``decontaminate`` removes
the hit spans, and whole documents in which they cover too much.

The benchmark may be of any size: its words are counted first and it is dealt into blocks of a bounded
number of words, one automaton each; a document's results from several blocks are united.

Defined results: null and empty texts, on either side, have no words; an empty benchmark hits nothing; rows
of a repeated item_id count as one item and repeated documents are judged row by row; items without an id mark
words but are not listed.  Columns of the input travel in one struct, so no name can clash.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm import matching
from mediaweave.llm.tables import stored


WINDOW = 10
#: Words of test items in one automaton, about 0.5 GB of it at most.
BLOCK_WORDS = 1_000_000
MAX_COVERAGE_PERCENT = 50

_SPANS = "array<struct<first:int,past:int>>"
_FOUND = f"n_words long, spans {_SPANS}, items array<string>, longest int"
_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))),
    pa.field("items", pa.list_(pa.string())),
    pa.field("longest", pa.int32()),
]


def _automata(benchmark: DataFrame, window: int, block_words: int):
    """Broadcast automata of bounded blocks of the items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("t"))
    # capitals are letters here: they are lower-cased later
    total = benchmark.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0]
    n = max(1, math.ceil((total or 0) / block_words))
    block = F.pmod(F.xxhash64("item_id", "t"), F.lit(n))
    for k in range(n):
        rows = (items if n == 1 else items.filter(block == k)).toLocalIterator()
        yield spark.sparkContext.broadcast(
            matching.Automaton([(r.item_id, matching.normal_words(r.t and bytes(r.t))) for r in rows], window)
        )


def _small(batches, rows: int = 100):
    """The same rows in batches whose words fit into a little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _scan(automaton, keep: list[str]):
    def run(batches):
        for batch in _small(batches):
            texts = batch.column("_text").cast(pa.binary())
            docs = [matching.normal_words(t) for t in texts.to_pylist()]
            found = automaton.value.scan(docs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [
                    pa.array(list(map(len, docs)), _ARROW[0].type),
                    pa.array([[{"first": a, "past": b} for a, b in s] for s, _, _ in found], _ARROW[1].type),
                    pa.array([sorted(i for i in items if i is not None) for _, items, _ in found], _ARROW[2].type),
                    pa.array([n for _, _, n in found], _ARROW[3].type),
                ],
                names=[*keep, *(f.name for f in _ARROW)],
            )

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` as the struct ``row`` with their number of words, hit spans, items and longest match."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").alias("_text"))
    automata = list(_automata(benchmark, window, block_words))
    if len(automata) == 1:
        kind = f"row {rows.schema['row'].dataType.simpleString()}, {_FOUND}"
        out = rows.mapInArrow(_scan(automata[0], ["row"]), kind)
    else:
        rows = stored(rows.withColumn("_n", F.monotonically_increasing_id()), "blocks")
        parts = [rows.mapInArrow(_scan(a, ["_n"]), f"_n long, {_FOUND}") for a in automata]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("_n").agg(
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max("longest").alias("longest"),
        )
        out = rows.select("_n", "row").join(found, "_n").drop("_n")
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s.first, s.past - 1)))
    hit = F.when(F.size("spans") == 0, 0).otherwise(F.size(F.array_distinct(places)))
    return out.withColumn("n_hit", hit.cast("bigint"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage_percent: int = MAX_COVERAGE_PERCENT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without hit spans; those that the spans cover beyond the limit go.  Same columns as ``docs``."""
    automata = list(_automata(benchmark, window, block_words))
    columns = docs.columns
    at, size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for batch in _small(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            words = [matching.normal_words(t) for t in texts]
            hit: dict[int, set[int]] = {}
            for a in automata:
                for i, (spans, _, _) in enumerate(a.value.scan(words)):
                    if spans:
                        hit.setdefault(i, set()).update(p for s in spans for p in range(*s))
            if hit:
                keep = [i not in hit or len(hit[i]) * 100 <= len(words[i]) * max_coverage_percent for i in range(len(texts))]
                for i in hit:
                    before = None
                    while keep[i] and before != texts[i]:
                        before = texts[i]
                        for a in automata:
                            texts[i] = matching.without_hits(texts[i], a.value)
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, pa.binary()).cast(arrays[at].type)
                if size is not None:
                    chars = arrays[size].to_pylist()
                    for i in hit:
                        chars[i] = len(texts[i].decode())
                    arrays[size] = pa.array(chars, arrays[size].type)
                batch = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
