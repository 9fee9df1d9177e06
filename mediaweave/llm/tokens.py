"""Token files of a corpus: whole texts encoded, written in ascending doc_id order, and read back.

Documents are sorted by id over the cluster; every task encodes its range and writes one file of
independent zstandard frames with a trailing seek table (``frames``).  A file gets its name only when it is
complete, so a repeated or lost task leaves nothing half-written, and its content depends on its rows alone.
Places in the whole sequence follow from the numbers of ids per file, one manifest row each.

Folders may be any that pyarrow's file systems open: local or mounted paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``.

Defined results: a null or empty text holds the end id only; a null doc_id comes first and stays null;
repeated ids follow each other in the order of their texts' hashes; an empty table writes no ids.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaweave.llm import bpe, frames
from mediaweave.llm.tables import shared_folder, stored


END_ID = 0
#: Documents that one reading task takes at a time.
READ_DOCS = 20_000


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write token files for (``doc_id``, ``text``) below ``folder``; returns their manifest.

    The manifest has a row per file: part, path, bytes, n_docs, n_ids and start, the ids of all files before it.
    """
    from pyarrow import fs

    with open(tokenizer or tokenizer_file(), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{place}/part-{part:06d}.tok"
        trial = f"{place}/.part-{part:06d}-{uuid.uuid4().hex}"
        files, _ = fs.FileSystem.from_uri(folder)
        encoder = bpe.worker_encoder(vocabulary.value)
        end = end_id.to_bytes(4, "little")
        with files.open_output_stream(trial) as out:
            writer = frames.Writer(out)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    writer.add(doc_id, encoder.encode(text.as_py() or "") + end)
            writer.close()
        size = files.get_file_info(trial).size
        files.move(trial, name)
        row = {"part": part, "path": os.path.basename(name), "bytes": size, "n_docs": len(writer.rows), "n_ids": writer.n_ids}
        yield pa.RecordBatch.from_pylist([row])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.sort("doc_id", F.xxhash64("text"))
    kind = "part long, path string, bytes long, n_docs long, n_ids long"
    manifest = stored(rows.mapInArrow(write, kind), "manifest")
    # one row per file: a window without keys stays small whatever the corpus
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before)


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32, and their ids (little-endian) if asked for."""
    from pyarrow import fs

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def read(batches):
        files, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{place}/{r['path']}"
                with files.open_input_file(path) as source:
                    reader = frames.Reader(source, r["bytes"])
                    at = r["start"] + int(reader.rows[: r["first"], 2].sum())
                    held: list[list] = [[] for _ in names]
                    size = 0
                    for doc_id, ids in reader.documents(r["first"], r["past"]):
                        values = [doc_id, at, len(ids) // 4, frames.crc(ids), ids]
                        for column, value in zip(held, values):
                            column.append(value)
                        at += len(ids) // 4
                        size += len(ids) if with_ids else 0
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, held, types)), names=names)
                            held, size = [[] for _ in names], 0
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held, types)), names=names)

    at = F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(READ_DOCS)))
    pieces = manifest.filter("n_docs > 0").select("path", "bytes", "start", "n_docs", at.alias("first"))
    pieces = pieces.withColumn("past", F.least(F.col("first") + READ_DOCS, "n_docs"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    tasks = min(10_000, max(1, manifest.count()))
    return pieces.repartition(tasks).mapInArrow(read, kind)


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return their documents as read back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer), folder)
