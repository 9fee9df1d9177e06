"""Row helper of the node scan: one page of HTML text to its elements.

It knows nothing of Spark; ``nodes`` runs it inside tasks on Arrow batches.
Malformed markup is read as HTML has it: void elements never open, no other element
is closed by a slash of its own, a missing end tag is implied for paragraphs, list items, table
cells, options, links and buttons, and an end tag closes everything opened since its
start tag.  Nothing is read twice, so a page takes time in proportion to its length.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa

# Elements without content, with raw text content, and whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "option": ("option", ("select", "datalist")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
}
TEXT_TAGS = frozenset(["a", "button"])
CONTEXT_KEYS = ("class", "style")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(r"</" + name + r"(?=[\s/>])", re.I) for name in RAW}


def _read_tag(html: str, pos: int) -> tuple[dict[str, str], int]:
    """Attributes from behind a tag's name, and the place behind its ``>``; -1 if the page ends first.

    A value is quoted only if a quote opens it; a quote elsewhere is an ordinary character.
    """
    found: dict[str, str] = {}
    end = len(html)
    while True:
        pos = _GAP.match(html, pos).end()
        if pos >= end:
            return found, -1
        if html[pos] == ">":
            return found, pos + 1
        m = _ATTR_NAME.match(html, pos)
        name, pos, value = m.group().lower(), m.end(), ""
        m = _EQUALS.match(html, pos)
        if m:
            pos = m.end()
            quote = html[pos : pos + 1]
            if quote in ('"', "'") and quote:
                stop = html.find(quote, pos + 1)
                if stop < 0:
                    return found, -1
                value, pos = html[pos + 1 : stop], stop + 1
            else:
                m = _BARE.match(html, pos)
                value, pos = m.group(), m.end()
        if name not in found:
            found[name] = html_lib.unescape(value) if "&" in value else value


def _next_markup(html: str, pos: int) -> tuple[int, str]:
    """Place and kind of the next comment (``!``), end tag (``/``) or start tag (``<``); kind is empty at the end."""
    while True:
        pos = html.find("<", pos)
        if pos < 0:
            return len(html), ""
        after = html[pos + 1 : pos + 2]
        if after in ("!", "?") and after:
            return pos, "!"
        if after.isascii() and after.isalpha():
            return pos, "<"
        if after == "/" and _NAME.match(html, pos + 2):
            return pos, "/"
        pos += 1


class _Open:
    """An element whose end tag has not been seen yet."""

    __slots__ = ("tag", "row", "attrs", "around", "texts", "parent")

    def __init__(self, tag, row, attrs, around, parent):
        self.tag, self.row, self.attrs, self.around, self.parent = tag, row, attrs, around, parent
        self.texts = [] if tag in TEXT_TAGS else None


class _Stack:
    """Open elements, with the depths at which each tag is open and those that collect text."""

    def __init__(self, rows: list[list]):
        self.rows, self.open = rows, []
        self.depths: dict[str, list[int]] = {}
        self.holders: list[_Open] = []

    def top(self) -> _Open | None:
        return self.open[-1] if self.open else None

    def push(self, el: _Open) -> None:
        self.depths.setdefault(el.tag, []).append(len(self.open))
        self.open.append(el)
        if el.texts is not None:
            self.holders.append(el)

    def deepest(self, tags) -> int:
        """Depth of the innermost open element with one of the tags, -1 if none is open."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def close(self, depth: int) -> None:
        """Close the elements from ``depth`` up."""
        while len(self.open) > depth:
            el = self.open.pop()
            self.depths[el.tag].pop()
            if el.texts is not None:
                self.rows[el.row][7] = " ".join(el.texts)
                self.holders.remove(el)


def _context(attrs: dict[str, str]) -> dict[str, str] | None:
    kept = {k: attrs[k] for k in CONTEXT_KEYS if k in attrs}
    return kept or None


def scan_page(page_id, page_url, html: str) -> list[list]:
    """Rows of one page, in document order, in time linear in the page's length."""
    rows: list[list] = []
    stack = _Stack(rows)
    seen: set = set()
    end = len(html)
    pos = 0
    while pos < end:
        at, kind = _next_markup(html, pos)
        if stack.holders and at > pos:
            piece = html_lib.unescape(html[pos:at]).strip()
            if piece:
                for el in stack.holders:
                    el.texts.append(piece)
        if not kind:
            break
        if kind == "!":
            close = "-->" if html.startswith("<!--", at) else ">"
            stop = html.find(close, at + 2)
            pos = stop + len(close) if stop >= 0 else end
            continue
        name_at = _NAME.match(html, at + (2 if kind == "/" else 1))
        name = name_at.group().lower()
        attrs, pos = _read_tag(html, name_at.end())
        if pos < 0:
            break  # a tag that never ends is no element
        if kind == "/":
            depth = stack.deepest((name,))
            if depth >= 0:
                stack.close(depth)
            continue
        if name in CLOSES_P or name in CLOSES:
            targets, limits = CLOSES.get(name, ("p", ("button", "td", "th", "table", "body", "a")))
            wanted = targets.split()
            again = "tr" in wanted or "td" in wanted
            while (depth := stack.deepest(wanted)) > stack.deepest(limits):
                stack.close(depth)
                if not again:
                    break
        elif name in TEXT_TAGS and (depth := stack.deepest((name,))) > stack.deepest(("td", "th", "table")):
            stack.close(depth)  # neither links nor buttons nest
        parent = stack.top()
        around = parent.around if parent else (None, None, None, None)
        node_id = len(rows)
        anchor, picture, form, video = around
        rows.append(
            [
                page_id, page_url, node_id, parent.row if parent else None, name, attrs,
                attrs["class"].split() if "class" in attrs else [],
                None, None,
                anchor.row if anchor else None, picture.row if picture else None,
                form.row if form else None, video.row if video else None,
                _first_of_kind(name, attrs, picture, seen),
                _context(parent.attrs) if parent else None,
                anchor.attrs if anchor and name == "img" else None,
                _context(anchor.parent.attrs) if anchor and anchor.parent and name == "img" else None,
                video.attrs if video and name == "source" else None,
                form.attrs if form and name in ("a", "button", "input") else None,
            ]
        )
        if name in VOID:
            continue
        if name in RAW:
            close = _RAW_END[name].search(html, pos)
            stop = close.start() if close else end
            text = html[pos:stop]
            rows[-1][8] = text if name in ("script", "style") else html_lib.unescape(text)
            gt = html.find(">", stop) if close else -1
            pos = gt + 1 if gt >= 0 else end
            continue
        el = _Open(name, node_id, attrs, around, parent)
        if name == "a" and "href" in attrs:
            el.around = (el, picture, form, video)
        elif name == "picture":
            el.around = (anchor, el, form, video)
        elif name == "form":
            el.around = (anchor, picture, el, video)
        elif name == "video":
            el.around = (anchor, picture, form, el)
        stack.push(el)
    stack.close(0)
    return rows


def _first_of_kind(name, attrs, picture, seen: set) -> bool | None:
    """Whether an image is the first of its picture, or a canonical link the first of its page."""
    if name == "img" and picture is not None:
        kind = picture.row
    elif name == "link" and "href" in attrs and "canonical" in attrs.get("rel", "").split():
        kind = "canonical"
    else:
        return None
    first = kind not in seen
    seen.add(kind)
    return first


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = []
    for values, field in zip(columns, schema):
        if pa.types.is_map(field.type):
            values = [None if v is None else list(v.items()) for v in values]
        arrays.append(pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def scan_batches(batches, schema: pa.Schema, marked_only: bool, rows_per_batch=1024):
    """Arrow batches of (page_id, url, html) to batches of node rows."""
    pending: list[list] = []
    for batch in batches:
        ids, urls, bodies = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            if body is None:
                continue
            rows = scan_page(ids[i].as_py(), urls[i].as_py(), body)
            pending.extend([r for r in rows if r[5] or r[4] == "script"] if marked_only else rows)
            while len(pending) >= rows_per_batch:
                yield _batch(pending[:rows_per_batch], schema)
                del pending[:rows_per_batch]
    if pending:
        yield _batch(pending, schema)
