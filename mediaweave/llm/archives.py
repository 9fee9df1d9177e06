"""ARC and WARC records as bytes; runs inside tasks, on file objects of any file system."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import uuid

# Fixed values of the formats.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"

LEVEL = 1
_NO_DATE = "1970-01-01T00:00:00Z"


def _member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def _field(value: str | None, absent: str) -> str:
    """A value fit for one field of a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "") or absent


def write_arc(out, name: str, version: str, date: str, records) -> int:
    """Write a legacy archive of (page_id, url, html); a gzip member per record.  Returns the number of records."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 mediaweave\n{fields}\n".encode()
    out.write(_member(_arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(about), name) + about + b"\n"))
    n = 0
    for page_id, url, html in records:
        payload = (html or "").encode()
        page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{page}\r\n"
        body = head.encode() + payload
        line = _arc_line(version, _field(url, "urn:x-none"), "0.0.0.0", date, "text/html", len(body), name)
        out.write(_member(line + body + b"\n"))
        n += 1
    return n


def _arc_line(version: str, url: str, ip: str, date: str, kind: str, length: int, name: str) -> bytes:
    more = f" 200 - - 0 {name}" if version == "2" else ""
    return f"{url} {ip} {date} {kind}{more} {length}\n".encode()


def _date(digits: str) -> str | None:
    """A 14-digit date, or its leading part, as a timestamp."""
    text = digits.strip()[:14]
    text += "00000101000000"[len(text) :]
    try:
        return dt.datetime.strptime(text, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def read_arc(source):
    """Records of a legacy archive, as dictionaries of its header fields with ``version``, ``nth``, ``block``, ``short``.

    The first record describes the file: its version and the names of the fields of all header lines.  URLs may
    hold blanks, so a line is split from its end.  A block is as long as its line declares.
    """
    data = gzip.GzipFile(fileobj=source)
    version, names, nth = "1", ARC_FIELDS["1"].split(), -1
    while line := data.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        first = nth < 0
        if first and len(parts) != len(names):
            parts = line.decode("utf-8", "replace").split()
            parts = [*parts[:4], parts[-1]]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no header line of a version {version} record: {line[:200]!r}")
        nth += 1
        record = dict(zip(names, parts))
        declared = int(parts[-1])
        record["block"] = data.read(declared)
        record["short"] = len(record["block"]) < declared
        if first:
            about = record["block"].decode("utf-8", "replace").split("\n")
            version = about[0].split(" ")[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown version {version!r}")
            names = about[1].split() if len(about) > 1 and about[1].startswith("URL") else ARC_FIELDS[version].split()
        record.update(version=version, nth=nth)
        yield record


def parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its blank line, and payload; a block that is no HTTP message is all payload."""
    if block.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            at = block.find(gap)
            if at >= 0:
                return block[: at + len(gap)], block[at + len(gap) :]
        return block, b""
    return b"", block


def header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def describe(record: dict, name: str) -> dict:
    """What a WARC record of this legacy record says of it."""
    head, payload = parts(record["block"])
    page = header(head, "X-Page-Id")
    url = record["URL"]
    return {
        "nth": record["nth"],
        "page_id": int(page) if page else None,
        "uri": url,
        "date": _date(record["Archive-date"]) or _NO_DATE,
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{record["nth"]} {url}')}>",
        "size": len(payload),
        "digest": hashlib.sha256(payload).hexdigest(),
    }


def _warc(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def to_warc(record: dict, name: str, refers: dict | None) -> bytes:
    """The equivalent WARC record; with ``refers`` a revisit of that record, which keeps the HTTP header only."""
    d = describe(record, name)
    head, payload = parts(record["block"])
    block, extra = record["block"], []
    if record["nth"] == 0:
        kind, content = "warcinfo", "application/warc-fields"
        block = f"software: mediaweave\r\nformat: WARC File Format 1.1\r\ndescription: from {name}\r\n".encode()
    elif head:
        kind, content = "response", HTTP_RESPONSE
    elif record["URL"].startswith("dns:"):
        kind, content = "resource", "text/dns"
    else:
        kind, content = "resource", record["Content-type"]
    if refers:
        kind, block = "revisit", head
        extra = [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", refers["record_id"]),
            ("WARC-Refers-To-Target-URI", refers["uri"]),
            ("WARC-Refers-To-Date", refers["date"]),
        ]
    return _member(
        _warc(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", d["record_id"]),
                ("WARC-Date", d["date"]),
                ("WARC-Filename" if kind == "warcinfo" else "WARC-Target-URI", name if kind == "warcinfo" else d["uri"]),
                ("WARC-IP-Address", record.get("IP-address")),
                ("WARC-Payload-Digest", f"sha256:{d['digest']}" if record["nth"] else None),
                ("WARC-Truncated", "length" if record["short"] else None),
                *extra,
                ("Content-Type", content),
            ],
            block,
        )
    )


def read_warc(source):
    """(header fields in lower case, block) of the records of a WARC file."""
    data = gzip.GzipFile(fileobj=source)
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:200]!r}")
        fields = {}
        while (line := data.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = data.read(int(fields["content-length"]))
        if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"damaged record {fields.get('warc-record-id')}")
        yield fields, block


def page_row(fields: dict, block: bytes) -> dict:
    """What a response or revisit record tells of its page."""
    head, payload = parts(block)
    page = header(head, "X-Page-Id")
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload in {fields['warc-record-id']}")
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": int(header(head, "Content-Length") or 0) if kind == "revisit" else len(payload),
        "payload_digest": digest,
        "record_type": kind,
        "record_id": fields["warc-record-id"],
        "refers": fields.get("warc-refers-to"),
    }
