"""Thumbnail-to-full-size rewriting as Column expressions.

A ``RuleBook`` holds rule and site-pattern rows that were checked when loaded.
They are configuration (hundreds of rows), so they are folded into the plan:
host-bound rules as one map literal looked up by host, global rules as literals
whose patterns compile once per task.  Rewriting then needs neither a join nor
a shuffle and adds no rows until its result array is exploded.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaweave.functions.urls import col, get_domain, let

_BLOCK = r"(?s)^(.*?)#([^#]+)#(.*)$"
_NO_STRINGS = "array<string>"
_RULES = "array<struct<rule_id:int,img:string,to:string>>"


def parse_srcset(c) -> Column:
    """Candidates of a ``srcset``: ``Nw`` gives N, ``Nx`` gives int(N * 1000), else 0."""
    items = F.filter(F.split(col(c), ","), lambda x: x.rlike(r"\S"))

    def read(item):
        desc = F.regexp_extract(item, r"^\s*\S+\s+(\S+)", 1)
        number = F.substring(desc, F.lit(1), F.length(desc) - 1)
        width = (
            F.when(desc.rlike(r"^[+-]?\d+w$"), number.try_cast("bigint"))
            .when(desc.endswith("x"), (number.try_cast("double") * 1000).try_cast("bigint"))
        )
        return F.struct(
            F.regexp_extract(item, r"(\S+)", 1).alias("url"),
            F.coalesce(width, F.lit(0).cast("bigint")).alias("width"),
        )

    return F.coalesce(F.transform(items, read), F.array().cast("array<struct<url:string,width:bigint>>"))


def _first_largest(items: Column, floor: int) -> Column:
    """URL of the largest score above ``floor``; the first wins a tie."""
    start = F.struct(F.lit(None).cast("string").alias("url"), F.lit(floor).cast("double").alias("score"))
    return F.aggregate(
        items,
        start,
        lambda acc, x: F.when(x["score"] > acc["score"], F.struct(x["url"].alias("url"), x["score"].alias("score")))
        .otherwise(acc),
        lambda acc: acc["url"],
    )


def largest_srcset(c, browser: bool = False) -> Column:
    """Largest candidate; the browser form also scores ``x`` densities and bare URLs."""
    items = F.filter(F.split(col(c), ","), lambda x: x.rlike(r"\S"))

    def read(item):
        desc = F.regexp_extract(item, r"^\s*\S+\s+(\S+)", 1)
        url = F.regexp_extract(item, r"(\S+)", 1)
        if not browser:
            score = F.regexp_extract(desc, r"(\d+)w", 1).try_cast("double")
        else:
            lead_int = F.nullif(F.regexp_extract(desc, r"^([+-]?\d+)", 1).try_cast("double"), F.lit(0.0))
            lead_num = F.nullif(F.regexp_extract(desc, r"^([+-]?\d*\.?\d+)", 1).try_cast("double"), F.lit(0.0))
            score = (
                F.when(desc.endswith("w"), F.coalesce(lead_int, F.lit(1.0)))
                .when(desc.endswith("x"), F.coalesce(lead_num, F.lit(1.0)) * 10000)
                .otherwise(F.lit(1.0))
            )
        return F.struct(url.alias("url"), F.coalesce(score, F.lit(0.0)).alias("score"))

    return _first_largest(F.transform(items, read), -1 if browser else 0)


def expand_variants(c) -> Column:
    """``a.#jpg png#`` to one string per option, for every block and line."""

    def once(s):
        options = F.filter(F.split(F.regexp_extract(s, _BLOCK, 2), r"\s+"), lambda o: o != "")
        head, tail = F.regexp_extract(s, _BLOCK, 1), F.regexp_extract(s, _BLOCK, 3)
        return F.when(s.rlike(_BLOCK), F.transform(options, lambda o: F.concat(head, o, tail))).otherwise(F.array(s))

    def line(s):
        blocks = F.floor((F.length(s) - F.length(F.replace(s, F.lit("#"), F.lit("")))) / 2).cast("int")
        rounds = F.when(blocks > 0, F.sequence(F.lit(1), blocks)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, F.array(s), lambda acc, _: F.flatten(F.transform(acc, once)))

    lines = F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.flatten(F.transform(lines, line)), F.array().cast(_NO_STRINGS))


def strip_size_suffix(c) -> Column:
    """Drop the first ``-300x200`` in front of an image extension."""
    return F.regexp_replace(
        col(c), r"(?is)^(.*?)-\d{2,4}x\d{2,4}(\.(?:jpe?g|png|webp|avif))(?=\z|\?)", "$1$2"
    )


def apply_replacements(url, replacements: Column) -> Column:
    """Feed the URL through ordered ``(source, target)`` regex replacements."""
    return F.aggregate(
        replacements,
        col(url),
        lambda u, r: F.regexp_replace(u, F.concat(F.lit("(?i)"), r["source"]), r["target"]),
    )


def without_scheme(c) -> Column:
    return F.regexp_replace(col(c), r"^.*?://", "")


def substitute(url, img: Column, to: Column) -> Column:
    """Result of one rule on one URL, or NULL when it does not apply.

    The pattern is tried on the whole URL, then without its scheme, which is
    put back afterwards.
    """
    url = col(url)
    pattern = F.concat(F.lit("(?i)"), img)
    bare = without_scheme(url)
    whole, partial = F.rlike(url, pattern), F.rlike(bare, pattern)
    cut = F.regexp_replace(bare, pattern, to)
    restored = F.when(cut.contains("://"), cut).otherwise(
        F.concat(F.regexp_extract(url, r"^(.*?://)", 1), cut)
    )
    out = F.when(whole, F.regexp_replace(url, pattern, to)).when(partial, restored)
    return F.when(out != url, out)


def rule_hit(url, img: Column) -> Column:
    pattern = F.concat(F.lit("(?i)"), img)
    return F.rlike(col(url), pattern) | F.rlike(without_scheme(url), pattern)


def _constant(value, kind: str) -> Column:
    """Rule data as one folded constant instead of an expression per rule."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rule(row: dict) -> dict:
    return {k: row[k] for k in ("rule_id", "img", "to")}


_QUANTIFIERS = "?*{+"
#: Escapes that stand for themselves; any other escape is not understood here.
_PLAIN_ESCAPES = frozenset("/.-_:?&=%#!~+,;@'()[]{}|^$*\"\\")


def required_literal(pattern: str) -> str | None:
    """Longest lower-cased text every match of the pattern must contain, if one is plain to see.

    Only ASCII text outside of groups and alternatives counts, and no character that a quantifier
    may drop.  A pattern with anything else than plain characters, escaped punctuation, simple classes,
    groups and quantifiers gives none.  Used to skip a pattern by a substring test.
    """
    best, run, depth, i = "", "", 0, 0
    while i < len(pattern):
        c, step, literal = pattern[i], 1, None
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt in _PLAIN_ESCAPES and nxt:
                literal = nxt
            elif not nxt or nxt not in "dDwWsSbB":
                return None
            step = 2
        elif c == "[":
            end = pattern.find("]", i + 2)
            body = pattern[i + 1 : end]
            if end < 0 or any(x in body for x in "[&") or re.search(r"\\[^dwsDWS./\-]", body) or body.endswith("\\"):
                return None
            step, literal = end + 1 - i, "." if body == "." else None
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith(("(?:", "(?<"), i) or pattern.startswith(("(?<=", "(?<!"), i):
                return None
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|":
            if depth == 0:
                return None
        elif c == "{":
            end = pattern.find("}", i)
            if end < 0:
                return None
            step = end + 1 - i
        elif c not in "^$.*+?":
            if not c.isascii() or c in "\n\r":
                return None
            literal = c
        after = pattern[i + step : i + step + 1]
        if literal and depth == 0 and (not after or after not in _QUANTIFIERS):
            run += literal
        else:
            run = ""
        best = run if len(run) > len(best) else best
        i += step
    # letters whose other cases lie outside ASCII would be missed by a lower-cased search
    return best.lower() if len(best) > 2 else None


def java_pattern(pattern: str) -> str:
    """A Python-style pattern in the engine's syntax: named groups, references to them, and the end of text."""
    def name(n):
        return n.replace("_", "U")

    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m[1])}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{name(m[1])}>", out)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)


_PYTHON_PART = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|(\$)", re.S)
_RULE_PART = re.compile(r"\$(\d{1,2})|\$<(\w+)>|(\$&)|(\$\$)|\\g<(\w+)>|\\(\d)|(\\.?|\$)", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r"}


def _group(ref: str, after: str) -> tuple[str, bool]:
    named = "${" + ref.replace("_", "U") + "}" if not ref.isdigit() else f"${int(ref)}"
    # a digit behind a numbered group is text
    return named, ref.isdigit() and after[:1].isdigit()


def _translated(target: str, parts: re.Pattern, one) -> str:
    out, at, escape = [], 0, False
    for m in parts.finditer(target):
        text = target[at : m.start()]
        out.append("\\" + text if escape and text else text)
        piece, escape = one(m, target[m.end() :])
        out.append(piece)
        at = m.end()
    text = target[at:]
    return "".join([*out, "\\" + text if escape and text else text])


def python_target(target: str) -> str:
    """A Python replacement (``\\1``, ``\\g<1>``, ``\\g<name>``) in the engine's syntax; ``$`` is text."""
    def one(m, after):
        if m[1] or m[2]:
            return _group(m[1] or m[2], after)
        if m[3]:
            c = _CONTROL.get(m[3], m[3])
            return "\\\\" if c == "\\" else c, False
        return "\\$", False

    return _translated(target, _PYTHON_PART, one)


def rule_target(target: str) -> str:
    """A rule's replacement (``$1``, ``$<name>``, ``$&``, ``$$``; ``\\1`` too) in the engine's syntax."""
    def one(m, after):
        if m[1]:
            return f"${int(m[1])}", False
        if m[2] or m[5] or m[6]:
            return _group(m[2] or m[5] or m[6], after)
        if m[3]:
            return "$0", after[:1].isdigit()
        if m[4]:
            return "\\$", False
        return "".join("\\" + c for c in m[7].replace("\\\\", "\\")), False

    return _translated(target, _RULE_PART, one)


@dataclass
class RuleBook:
    """Checked rewrite rules, in file order.

    ``rules``: dicts with rule_id, ord, name, link, img, to, res, domain.
    ``patterns``: dicts with site, domains, url_patterns, replacements.
    ``thumbnails``: (source, target) pairs tried when nothing else applied.
    """

    rules: list[dict] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)
    thumbnails: list[tuple[str, str]] = field(default_factory=list)
    rejects: list[dict] = field(default_factory=list)

    # -- pieces as columns --

    @property
    def rewriting(self) -> list[dict]:
        return [r for r in self.rules if r.get("img") and r.get("to")]

    def host_rules(self, page_url, url) -> Column:
        """Host-bound rules in order: page host, then image host, each also less ``www.``."""
        none = F.array().cast(_RULES)
        by_host: dict[str, list[dict]] = {}
        for rule in self.rewriting:
            if rule.get("domain"):
                by_host.setdefault(rule["domain"], []).append(rule)
        if not by_host:
            return none
        packed = {host: [_rule(r) for r in rows] for host, rows in by_host.items()}
        index = _constant(packed, f"map<string,{_RULES}>")

        def at(host):
            short = F.when(host.startswith("www."), F.substring(host, 5, 10000))
            return [F.coalesce(index[host], none), F.coalesce(index[short], none)]

        page_host, image_host = get_domain(page_url), get_domain(url)
        return F.concat(*at(page_host), *at(F.when(image_host != page_host, image_host)))

    def global_rules(self, url=None) -> Column:
        """Rules bound to no host: all of them, or those found in ``url``, in order.

        A rule whose pattern has a fixed part is only tried on URLs that contain
        that part; the few others are literals that compile once per task.
        """
        rows = [r for r in self.rewriting if not r.get("domain")]
        if not rows:
            return F.array().cast(_RULES)
        if url is None:
            return _constant([_rule(r) for r in rows], _RULES)
        kind = "struct<pos:int,text:string,rule:struct<rule_id:int,img:string,to:string>>"
        placed = [{"pos": n, "text": required_literal(r["img"]), "rule": _rule(r)} for n, r in enumerate(rows)]
        screened = _constant([p for p in placed if p["text"]], f"array<{kind}>")
        always = [p for p in placed if not p["text"]]

        def found(low):
            hits = F.filter(screened, lambda p: low.contains(p["text"]) & rule_hit(url, p["rule"]["img"]))
            if not always:
                return hits
            tested = [F.when(rule_hit(url, F.lit(p["rule"]["img"])), _constant(p, kind)) for p in always]
            return F.array_sort(F.concat(hits, F.array_compact(F.array(*tested))))

        return F.transform(let(F.lower(col(url)), found), lambda p: p["rule"])

    def rules_for_hosts(self, page_url, url) -> Column:
        return F.concat(self.host_rules(page_url, url), self.global_rules())

    def rule_hits(self, url, page_url, lookup_url=None) -> Column:
        """Candidate rules whose pattern is found in the URL, in candidate order."""
        bound = self.host_rules(page_url, url if lookup_url is None else lookup_url)
        return F.concat(
            F.filter(bound, lambda r: rule_hit(url, r["img"])),
            self.global_rules(url),
        )

    def site_replacements(self, url, page_url) -> Column:
        """Replacements of the site patterns of the URL, else of the page."""
        if not self.patterns:
            return F.array().cast("array<struct<source:string,target:string>>")

        def tests(u):
            low = F.lower(col(u))
            host = get_domain(low)
            out = []
            for p in self.patterns:
                test = F.lit(False)
                for d in p.get("domains") or []:
                    test = test | host.contains(d.lower())
                for rx in p.get("url_patterns") or []:
                    test = test | low.rlike("(?i)" + rx)
                out.append(test)
            return out

        on_url, on_page = tests(url), tests(page_url)
        any_url = on_url[0]
        for t in on_url[1:]:
            any_url = any_url | t
        steps = []
        for p, u, g in zip(self.patterns, on_url, on_page):
            for source, target in p.get("replacements") or []:
                steps.append(
                    F.struct(
                        F.lit(source).alias("source"),
                        F.lit(target).alias("target"),
                        F.when(any_url, u).otherwise(g).alias("on"),
                    )
                )
        return F.filter(F.array(*steps), lambda s: s["on"])

    def thumbnail_replacements(self) -> Column:
        pairs = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in self.thumbnails]
        return F.array(*pairs) if pairs else F.array().cast("array<struct<source:string,target:string>>")

    # -- the whole chain --

    def apply_rules(self, url, page_url, lookup_url=None) -> Column:
        """Every variant of every matching rule, in candidate order."""
        def one(rule):
            return expand_variants(substitute(url, rule["img"], rule["to"]))

        return F.flatten(F.transform(self.rule_hits(url, page_url, lookup_url), one))

    def transform(self, url, page_url) -> Column:
        """Ordered distinct candidates for an image URL, the URL itself first if unchanged."""
        url, page_url = col(url), col(page_url)
        if not (self.rewriting or self.patterns or self.thumbnails):
            return F.array(strip_size_suffix(url))

        def finish(v):
            first = v["first"]
            changed = (first != v["url"]) | (F.size(v["more"]) > 0)
            return (
                F.when(changed, F.concat(F.array(first), v["more"]))
                .when(v["thumb"] != v["url"], F.array(v["thumb"]))
                .otherwise(F.array(strip_size_suffix(first)))
            )

        def rules_step(v):
            more = self.apply_rules(v["first"], v["page"], v["url"]) if self.rewriting else F.array().cast(_NO_STRINGS)
            thumb = apply_replacements(v["url"], self.thumbnail_replacements()) if self.thumbnails else v["url"]
            return let(
                F.struct(v["url"].alias("url"), v["first"].alias("first"), more.alias("more"), thumb.alias("thumb")),
                finish,
            )

        first = apply_replacements(url, self.site_replacements(url, page_url)) if self.patterns else url
        bound = F.struct(url.alias("url"), page_url.alias("page"), first.alias("first"))
        return F.array_distinct(let(bound, rules_step))
