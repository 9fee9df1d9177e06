"""Language identification by cross-parsing entropy.

A suffix automaton per language is built from a bounded sample of labelled text.  A text is parsed
greedily into the longest phrases that occur in a language's sample; the language that needs the fewest
phrases, each weighed by the bits that name a place in its sample, wins.  Texts are reduced to lower-case
letters and blanks first; every text is parsed whole, in stretches of a fixed number of bytes.

The sample is bounded by ``TOTAL_BYTES``, shared evenly by all labels of the training rows, and
``LANGUAGE_BYTES`` for one; a document gives at most ``LEAD`` characters.  A language learns from its different
leads in the order of their hashes until its share is full, so copies take no room from other texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is
nothing to learn from; equal counts go to the first label in order; with one language the score is 1.  Rows
without a label, and held-out rows, teach nothing.  A null id is not held out.  Columns of the input travel in
one struct, so no name can clash.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.llm import phrases


LANGUAGE_BYTES = 40_000
TOTAL_BYTES = 400_000
LEAD = 1_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Every third document, by the checksum of its id, is kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _least(wanted: int, told):
    """The texts with the smallest hashes of every language, as many as fill ``wanted`` bytes, out of Arrow batches
    of (lang, h, text); ``told`` makes bytes of a text.  What is left out of a part of the rows is none of all rows'."""

    def run(batches):
        texts: dict[str, dict[int, bytes]] = {}
        heaps: dict[str, list[int]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held, heap = texts.setdefault(lang, {}), heaps.setdefault(lang, [])
                if h in held or (heap and h > -heap[0] and sizes[lang] >= wanted) or not (more := told(text.as_py())):
                    continue
                held[h] = more[:wanted]
                heapq.heappush(heap, -h)
                size = sizes.get(lang, 0) + len(held[h]) + 1
                while size - len(held[-heap[0]]) - 1 >= wanted:
                    size -= len(held.pop(-heapq.heappop(heap))) + 1
                sizes[lang] = size
        for lang, held in texts.items():
            columns = [pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.int64())]
            columns.append(pa.array(list(held.values()), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "text"])

    return run


def train(labelled: DataFrame) -> phrases.Languages:
    """Automata from (``text``, ``lang``); what is collected stays within a small multiple of the byte bounds."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("lang", F.substring("text", 1, LEAD).alias("lead")).filter(F.col("lead").rlike(r"\p{L}"))
    n = rows.select("lang").distinct().count()
    if not n:
        return phrases.Languages({})
    wanted = max(1, min(LANGUAGE_BYTES, TOTAL_BYTES // n))
    kind = "lang string, h long, text binary"
    drawn = rows.select("lang", F.xxhash64("lead").alias("h"), "lead").mapInArrow(_least(wanted, phrases.letters), kind)
    sample = drawn.repartition("lang").mapInArrow(_least(wanted, bytes), kind)
    found: dict[str, bytes] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        found[r["lang"]] = (found.get(r["lang"], b"") + b" " + bytes(r["text"]))[:wanted]
    return phrases.Languages(found)


def identify(docs: DataFrame, model: phrases.Languages, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (without the text) as the struct ``row`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [F.col(c) for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
