"""Seekable token files: independent zstandard frames, a document index and a trailing seek table.

File layout, in frames:

* data frames: the ids of whole documents, little-endian unsigned 32-bit, about ``FRAME_IDS`` ids each;
* one index frame: the number of documents n, then n rows of (frame, place in it, number of ids, id is
  null) and n document ids, all little-endian signed 64-bit;
* a skippable frame with the seek table of the public seekable format: compressed size, content size and
  checksum (low 32 bits of XXH64 of the content) of every frame before it, their number, a descriptor byte
  and the magic number.

A reader fetches the seek table at the end, then the index frame, then only the frames it needs; every frame is
checked before use.  The functions take file objects, so any file system will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import xxhash
import zstandard

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = "<IBI"
FOOTER_SIZE = struct.calcsize(FOOTER)
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

#: Ids after which a frame is closed; a frame holds whole documents.
FRAME_IDS = 1 << 18


class Writer:
    """Append documents in order; ``close`` writes index and seek table."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.doc_ids: list[int] = []
        self.pending: list[bytes] = []
        self.held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if n > 2**29:
            raise ValueError("a document of more than 2 GB of ids does not fit a frame")
        if self.held and self.held + n > self.frame_ids:
            self._flush()
        self.rows.append((len(self.entries), self.held, n, doc_id is None))
        self.doc_ids.append(doc_id or 0)
        self.pending.append(ids)
        self.held += n
        self.n_ids += n

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.pending))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = np.array(self.rows, "<i8").reshape(-1, 4)
        self._frame(struct.pack("<q", len(index)) + index.tobytes() + np.array(self.doc_ids, "<i8").tobytes())
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack(FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to the documents of a file of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack(FOOTER, self._read(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        self.entries = np.frombuffer(self._read(size - FOOTER_SIZE - n * ENTRY.itemsize, n * ENTRY.itemsize), ENTRY)
        self.starts = np.concatenate(([0], np.cumsum(self.entries["packed"].astype(np.int64))))
        index = self.frame(n - 1)
        (n_docs,) = struct.unpack_from("<q", index)
        values = np.frombuffer(index, "<i8", offset=8)
        self.rows = values[: 4 * n_docs].reshape(-1, 4)
        self.doc_ids = values[4 * n_docs :]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("file ends early")
        return data

    def frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.entries[k])
        content = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, first: int = 0, past: int | None = None):
        """(doc_id, ids) of the documents at these places of the file; unpacks only their frames."""
        held, content = -1, b""
        for row, doc_id in zip(self.rows[first:past].tolist(), self.doc_ids[first:past].tolist()):
            k, at, n, null = row
            if n and k != held:
                held, content = k, self.frame(k)
            yield None if null else doc_id, content[4 * at : 4 * (at + n)] if n else b""


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
