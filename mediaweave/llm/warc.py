"""Legacy ARC archives to WARC, and back to rows.

``write_arc`` lays down a table of pages as legacy archives, of both versions in turn.  ``convert`` reads
legacy archives by the header lines of their version and the declared lengths, and writes for each an
equivalent WARC file with identifiers, timestamps, types and digests.  Which of several records with the same
payload stays a response is settled on digests alone, by one aggregation and one join; payloads never move
between tasks.  ``read_warc`` reads WARC files back, checking every digest.

Files get their names when complete and their content depends on their rows alone, so tasks may be
repeated.  Folders may be any that pyarrow's file systems open.

Defined results: a null html is an empty payload; a null url becomes ``urn:x-none``; a null page_id is
kept as null and counts as largest; rows with the same page_id and payload are revisits but for one; control
characters and blanks of a url are percent-encoded.  An empty table gives empty archives.  Other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.llm import archives
from mediaweave.llm.tables import shared_folder, stored


MIN_REVISIT_BYTES = 100
#: Payload bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
CRAWL_DATE = "20200101000000"

_INDEX = "file string, nth long, page_id long, uri string, date string, record_id string, size long, digest string"
_INDEX_ARROW = pa.schema(
    [("file", pa.string()), ("nth", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()),
     ("record_id", pa.string()), ("size", pa.int64()), ("digest", pa.string())]
)
_PAGE_ARROW = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string())]
)
_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _complete(files, place: str, name: str, write):
    """Write a file under a trial name and give it its own when all is there."""
    trial = f"{place}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(trial) as out:
        result = write(out)
    files.move(trial, f"{place}/{name}")
    return result


def _batches(rows, schema: pa.Schema, n: int = 5_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _spread(files: DataFrame) -> DataFrame:
    """A task per file, as far as there are not too many."""
    return files.repartition(min(10_000, max(1, files.count())))


def write_arc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = CRAWL_DATE) -> DataFrame:
    """Legacy archives of (``page_id``, ``url``, ``html``); returns (file, n_records)."""
    files, place = _opened(folder)
    files.create_dir(place, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, place = _opened(folder)
        waiting = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        spare: list[tuple] = []

        def some():
            size = 0
            for row in waiting:
                if size and size + len(row[2] or "") > archive_bytes:
                    spare.append(row)
                    return
                size += len(row[2] or "")
                yield row

        k, made = 0, []
        first = next(waiting, None)
        while first is not None:
            name = f"part-{part:06d}-{k:04d}.arc.gz"
            records = (r for source in ([first], some()) for r in source)
            n = _complete(
                files, place, name, lambda out: archives.write_arc(out, name, "12"[(part + k) % 2], date, records)
            )
            made.append({"file": name, "n_records": n})
            k += 1
            first = spare.pop() if spare else next(waiting, None)
        yield pa.RecordBatch.from_pylist(made, pa.schema([("file", pa.string()), ("n_records", pa.int64())]))

    return stored(rows.mapInArrow(write, "file string, n_records long"), "arcs")


def index_arc(arcs: DataFrame, folder: str) -> DataFrame:
    """A row per record of the legacy archives, without payloads."""

    def read(batches):
        files, place = _opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_file(f"{place}/{name}") as source:
                    rows = ({"file": name, **archives.describe(r, name)} for r in archives.read_arc(source) if r["nth"])
                    yield from _batches(rows, _INDEX_ARROW)

    return stored(_spread(arcs.select("file")).mapInArrow(read, _INDEX), "arc-index")


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Per file its records whose payload another record holds, with that record."""
    large = index.filter(F.col("size") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", "file", "nth", "record_id", "uri", "date")
    first = large.groupBy(F.col("digest").alias("of")).agg(F.min(order).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = large.join(first, F.col("digest") == F.col("of")).filter(
        (F.col("f.file") != F.col("file")) | (F.col("f.nth") != F.col("nth"))
    )
    refers = F.struct("nth", F.col("f.record_id").alias("record_id"), F.col("f.uri").alias("uri"), F.col("f.date").alias("date"))
    return again.groupBy("file").agg(F.collect_list(refers).alias("again"))


def convert(arcs: DataFrame, arc_folder: str, warc_folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A WARC file for each legacy archive in ``arcs`` (``file``); returns (file, n_records)."""
    files, place = _opened(warc_folder)
    files.create_dir(place, recursive=True)
    work = stored(arcs.select("file").join(revisits(index_arc(arcs, arc_folder), min_bytes), "file", "left"), "revisits")

    def write(batches):
        source_files, source_place = _opened(arc_folder)
        files, place = _opened(warc_folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = row["file"]
                again = {r["nth"]: r for r in row["again"] or []}
                target = name.replace(".arc", ".warc")

                def copy(out, name=name, again=again):
                    n = 0
                    with source_files.open_input_file(f"{source_place}/{name}") as source:
                        for record in archives.read_arc(source):
                            out.write(archives.to_warc(record, name, again.get(record["nth"])))
                            n += 1
                    return n

                n = _complete(files, place, target, copy)
                yield pa.RecordBatch.from_pylist([{"file": target, "n_records": n}])

    return stored(_spread(work).mapInArrow(write, "file string, n_records long"), "warcs")


def read_warc(warcs: DataFrame, folder: str) -> DataFrame:
    """Pages of WARC files: page_id, payload_bytes, payload_digest, record_type and refers_to."""

    def read(batches):
        files, place = _opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_file(f"{place}/{name}") as source:
                    kinds = ("response", "revisit")
                    rows = (archives.page_row(f, b) for f, b in archives.read_warc(source) if f["warc-type"] in kinds)
                    yield from _batches(rows, _PAGE_ARROW)

    rows = stored(_spread(warcs.select("file")).mapInArrow(read, _PAGE), "warc-pages")
    wanted = rows.filter("refers IS NOT NULL").select("refers").distinct()
    target = rows.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")).join(wanted, "refers")
    out = rows.join(target, "refers", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def page_archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages through legacy archives to WARC files in the shared folder and back."""
    old, new = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    return read_warc(convert(write_arc(pages, old), old, new), new)
