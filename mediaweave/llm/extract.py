"""Main text of web pages by minimum-cut labelling.

A page is a list of text blocks in a tree of elements.  A linear classifier gives each block a score for being content (its
weights are fixed, as no labelled pages are at hand); the score is the block's capacity to the source or the sink.
Blocks that follow each other, and blocks next to each other below one element, are joined by edges that are the
stronger the nearer they are in the tree.  The minimum cut of this graph separates content from boilerplate: clear blocks
decide by themselves, unclear ones go with their surroundings.

Every row of the input is judged by itself.  Defined results: null, empty and blank pages have an empty text; text without any
markup is one block; repeated rows give repeated rows; an empty table gives no rows.  Columns of the input travel in one struct,
so no name can clash.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.markup import Block, Element, blocks_of
from mediaweave.llm.mincut import source_side

# What elements, roles and words in class or id say about the text below them.
SIDE_TAGS = {"nav": -7, "footer": -6, "aside": -6, "form": -6, "dialog": -6, "menu": -6, "header": -4, "fieldset": -4, "legend": -4, "search": -6}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note", "status"}
SIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars sidenav aside rail footer footnav header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup signin login "
    "share sharing social related recommended recommendations recirc teaser teasers widget widgets pagination pager search form copyright disclaimer "
    "legal skip tagcloud tags outbrain taboola donate".split()
)
COMMENT_WORDS = set("comment comments commentlist reply replies respond responses discussion disqus reactions reviews guestbook".split())
#: Beginnings of words in class or id that say so as well.
SIDE_STARTS = ("cookie", "advert", "adsby", "adslot", "adunit", "sidebar", "footer", "navbar", "breadcrumb", "newsletter", "sponsor", "promo")
COMMENT_STARTS = ("comment", "disqus")
MAIN_TAGS = {"article": 3, "main": 2}
MAIN_WORDS = {"article": 2, "content": 2, "post": 2, "entry": 2, "story": 2, "articlebody": 3, "main": 1, "maincontent": 2, "text": 1, "body": 1}
TAG_SCORES = {
    "p": 1.0, "h1": 1.5, "h2": 0.7, "h3": 0.6, "h4": 0.5, "h5": 0.4, "h6": 0.4, "pre": 1.0, "blockquote": 1.0, "figcaption": 0.3,
    "li": -0.6, "td": -0.3, "th": -0.4, "option": -3.0, "legend": -3.0, "caption": 0.0,
}
RIGHTS = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos", re.I)

#: Points against a block outside the page's main part: if there is none, one that a class names, one that the markup names.
OUTSIDE = (0.0, -1.5, -4.0)

#: Capacity units of one point of the score, and of the strongest edges.
UNIT = 100
NEXT = 1.2
SIBLING = 0.8
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(element: Element) -> list[str]:
    """Words of class and id, without those that only say that something is there or not ("has-sidebar")."""
    out: list[str] = []
    for name in (element.hints.get("class", "") + " " + element.hints.get("id", "")).split()[:50]:
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] in ("has", "no", "with", "without", "is", "js"):
            continue
        out += words + ["".join(words)]
        # "content-with-sidebar"
        for k, w in enumerate(words):
            if w in ("with", "has", "no", "without"):
                out = out[: len(out) - len(words) - 1] + words[:k]
                break
    return out


def _named(element: Element) -> bool:
    """Whether the markup itself says that this is the page's main part."""
    hints = element.hints
    return element.name in MAIN_TAGS or hints.get("role", "").lower() in ("main", "article") or "articleBody" in hints.get("itemprop", "")


def _said(element: Element, holds_main: bool) -> tuple[float, float]:
    """(points against, points for) the text of an element, by the element alone."""
    if element.name in ("html", "body"):
        return 0, 0
    against, good = SIDE_TAGS.get(element.name, 0), MAIN_TAGS.get(element.name, 0)
    hints = element.hints
    if hints:
        role = hints.get("role", "").lower()
        if role in SIDE_ROLES:
            against = min(against, -6)
        elif role in ("main", "article"):
            good = max(good, 2)
        if "hidden" in hints or hints.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(hints.get("style", "")):
            against = min(against, -8)
        names = _names(element) + [w.lower() for w in hints.get("itemprop", "").split()]
        main = max((MAIN_WORDS.get(w, 0) for w in names), default=0)
        if any(w in COMMENT_WORDS or w.startswith(COMMENT_STARTS) for w in names):
            return min(against, -9), good
        if any(w in SIDE_WORDS or w.startswith(SIDE_STARTS) for w in names):
            # an article's own header holds its title
            own = main and any(w in ("header", "banner") for w in names)
            against = min(against, -1 if own else -7)
        else:
            good = max(good, main)
    # a frame around the article says nothing about it
    if holds_main and element.name in ("form", "header", "fieldset", "section", "div", "dialog") and against > -8:
        against = 0
    return against, good


def _surroundings(elements: list[Element]) -> list[tuple[float, float, int]]:
    """For every element the sum of points against, and the most points for, of itself and all around it; and how it belongs
    to a main part: by markup (2), by class (1), or not (0)."""
    holds = bytearray(len(elements))
    for e in reversed(elements):
        if e.parent and (holds[e.number] or _named(e)):
            holds[e.parent.number] = 1
    out: list[tuple[float, float, int]] = []
    for e in elements:
        against, good = _said(e, bool(holds[e.number]))
        part = 2 if _named(e) else int(good >= 2)
        if e.parent:
            a, g, around = out[e.parent.number]
            if e.name == "header" and g >= 2 and not holds[e.number]:
                against = max(against, -1)  # an article's own header
            against, good, part = max(a + against, -20), max(g, good), max(around, part)
        out.append((against, good, part))
    return out


def _score(block: Block, against: float, good: float, outside: float) -> float:
    text, words = block.text, block.text.count(" ") + 1
    score = -0.6 + TAG_SCORES.get(block.element.name, 0.0) + against + good + outside
    score += min(3.0, 0.35 * math.log2(words))
    score -= 4.0 * min(1.0, block.linked / max(1, len(text) - words + 1)) * (0.4 if good >= 2 and not against else 1)
    if text.rstrip("\"'”’»)]")[-1:] in ".!?…。！？؟।":
        score += 0.8
    elif words < 4:
        score -= 0.5
    if words < 40 and RIGHTS.search(text):
        score -= 3.0
    return score


def _steps(a: Element, b: Element) -> int:
    """Elements between two in the tree, 12 at most."""
    n = 0
    while a is not b and n < 12:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def _edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    out = []
    below: dict[int, int] = {}  # the last block below an element
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, int(UNIT * NEXT / max(1, _steps(blocks[i - 1].element, block.element) - 1))))
        parent = block.element.parent
        if parent:
            j = below.get(parent.number, i - 1)
            if j < i - 1:
                out.append((j, i, int(UNIT * SIBLING)))
            below[parent.number] = i
    return out


def main_text(page: str | None) -> str:
    """Main text of one page: its content blocks, joined by empty lines."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return ""
    around = _surroundings(elements)
    places = [around[b.element.number] for b in blocks]
    main = max((part for against, _, part in places if against > -4), default=0)
    terminals = [
        round(UNIT * _score(b, against, good, 0.0 if part >= main else OUTSIDE[main])) for b, (against, good, part) in zip(blocks, places)
    ]
    if min(terminals) > 0:
        content = [True] * len(blocks)
    elif max(terminals) <= 0:
        content = [False] * len(blocks)
    else:
        content = source_side(terminals, _edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, content) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` as the struct ``row`` (without the html), their main text and its length in code points."""
    rows = pages.select(F.struct(*[c for c in pages.columns if c != "html"]).alias("row"), F.col("html").cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            at, held, texts = 0, 0, []
            pages = batch.column(1)
            for i in range(batch.num_rows):
                texts.append(main_text(pages[i].as_py()))
                held += len(texts[-1])
                if held > 1 << 22 or i == batch.num_rows - 1:
                    columns = [batch.column(0).slice(at, len(texts)), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_chars"])
                    at, held, texts = i + 1, 0, []

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long")
