"""Text blocks of a web page with what surrounds them; one linear pass, runs inside tasks."""

from __future__ import annotations

import html
import re

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: all up to their end tag goes.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements whose text is not part of the page's prose.
SILENT = frozenset("head template svg math object canvas audio video select button datalist map applet".split())
#: A start tag of these ends an open element of the same kind, up to the element that holds them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_P_SCOPE = ("table", "td", "th", "caption", "button", "object")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Element:
    __slots__ = ("name", "hints", "parent", "number", "depth")

    def __init__(self, name: str, hints: dict[str, str], parent: Element | None, number: int):
        self.name, self.hints, self.parent, self.number = name, hints, parent, number
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def _attributes(page: str, at: int, quotes: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """Attributes from ``at`` on, the place after the tag (-1: never ends), and whether it closes itself."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return found, end + 1 if end >= 0 else -1, end > 0 and page[end - 1] == "/"
        name, at = m.group(1).lower(), m.end()
        value = ""
        if m.group(2):
            q = page[at : at + 1]
            if q in ('"', "'") and q and at < quotes[q]:
                end = page.index(q, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m.group(), m.end()
        found.setdefault(name, value)


class _Page:
    def __init__(self):
        root = Element("html", {}, None, 0)
        self.elements, self.open, self.blocks = [root], [root], []
        self.places: dict[str, list[int]] = {"html": [0]}  # where a name is open
        self.block_at = [0]  # where block elements are open
        self.silent = 0
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self.open[self.block_at[-1]], min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if not self.silent:
            text = html.unescape(raw)
            self.pieces.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        block = name in BLOCKS
        if block:
            self.end_block()
            if self.last("p") > max(map(self.last, _P_SCOPE)):
                self.pop(self.last("p"))
        if name in _ENDS:
            same, holders = _ENDS[name]
            at = max(map(self.last, same))
            if at > max(map(self.last, holders)):
                self.pop(at)
        if name == "br":
            self.pieces.append(" ")
        if name in VOID:
            return
        hints = {k: attributes[k] for k in ("class", "id", "role", "itemprop", "style", "hidden", "aria-hidden") if k in attributes}
        element = Element(name, hints, self.open[-1], len(self.elements))
        self.elements.append(element)
        if closed and name in ("svg", "math"):
            return
        self.places.setdefault(name, []).append(len(self.open))
        if block:
            self.block_at.append(len(self.open))
        self.open.append(element)
        self.silent += name in SILENT
        self.links += name == "a"

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def pop(self, to: int) -> None:
        """Close all elements from place ``to`` on."""
        if self.block_at[-1] >= to:
            self.end_block()
        while len(self.open) > max(1, to):
            name = self.open.pop().name
            self.places[name].pop()
            if name in BLOCKS:
                self.block_at.pop()
            self.silent -= name in SILENT
            self.links -= name == "a"

    def end(self, name: str) -> None:
        at = self.last(name)
        if name in BLOCKS:
            self.end_block()
        # an inline element does not close the blocks in it
        if at > 0 and (name in BLOCKS or name in SILENT or at > self.block_at[-1]):
            self.pop(at)


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, and all elements, parents before children."""
    out, at = _Page(), 0
    quotes = {q: page.rfind(q) for q in "\"'"}
    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            out.text(page[at:])
            break
        if tag > at:
            out.text(page[at:tag])
        after = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 2)  # <!--> is a whole comment
            at = end + 3 if end >= 0 else len(page)
        elif after in ("!", "?") and after:
            end = page.find(">", tag)
            at = end + 1 if end >= 0 else len(page)
        elif after == "/" and (m := _NAME.match(page, tag + 2)):
            end = page.find(">", m.end())
            if end < 0:
                break
            out.end(m.group().lower())
            at = end + 1
        elif after == "/" and page[tag + 2 : tag + 3]:
            end = page.find(">", tag)
            at = end + 1 if end >= 0 else len(page)
        elif m := _NAME.match(page, tag + 1):
            name = m.group().lower()
            attributes, at, closed = _attributes(page, m.end(), quotes)
            if at < 0:
                break
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                if not end:
                    break
                end = page.find(">", end.end())
                if end < 0:
                    break
                at = end + 1
            elif name == "plaintext":
                out.start(name, attributes, closed)
                out.text(page[at:])
                break
            else:
                out.start(name, attributes, closed)
        else:
            out.text("<")
            at = tag + 1
    out.end_block()
    return out.blocks, out.elements
