"""Rewrite rules and site patterns as indexed tables.

A book (``rule_book``) folds its rules into the plan, which suits a file that a person keeps.  An index keeps them as tables of any
size.  Checking, indexing and matching are joins, so no rule passes through the driver and the plan does not depend on their number:

* host-bound rules meet URLs by one equi join on the host, whose tier (page, image, each less ``www.``) gives the order;
* a rule for all hosts is filed under one piece of the text its pattern must contain, the piece that the fewest rules have; URLs are
  cut into all their pieces, and only rules met by an equal piece are tried;
* domains of site patterns may stand anywhere in a host, so hosts are cut into the substrings of the lengths that occur.

Patterns without any text that they must contain have no piece.  They are tried on every URL, as constants of at most ``chunk``
patterns a pass.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.functions import rewrite
from mediaweave.functions import urls as U
from mediaweave.functions.rewrite import _constant, apply_replacements, expand_variants, strip_size_suffix, substitute
from mediaweave.session import cut_lineage

# executors need no copy of this package
cloudpickle.register_pickle_by_value(rewrite)

#: Patterns without a text to find them by that one pass over the URLs tries.
CHUNK = 1000
#: Size up to which an index is sent to all tasks.
BROADCAST_BYTES = 16_000_000
#: Lengths of the pieces that texts are found by; the longest that fits is taken.
PIECES = (6, 3)


def _compiles(pattern: Column) -> Column:
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, F.lit("")).isNotNull()


def _replaces(pattern: Column, target: Column) -> Column:
    """Whether a replacement can be carried out; tried on an empty text, which the pattern or nothing matches."""
    trial = F.concat(F.lit("(?:"), pattern, F.lit(")|"))
    return F.try_reflect(F.lit("org.apache.commons.lang3.RegExUtils"), F.lit("replaceAll"), F.lit(""), trial, target).isNotNull()


def _translated(df: DataFrame, patterns: list[str], targets: list[str], lists: list[str] = (), target=None) -> DataFrame:
    """Columns of patterns and targets in the engine's syntax."""
    names = df.columns
    change = {**dict.fromkeys(patterns, rewrite.java_pattern), **dict.fromkeys(targets, target)}

    def run(batches):
        for batch in batches:
            arrays = []
            for name, column in zip(names, batch.columns):
                if name in change:
                    column = pa.array([v and change[name](v) for v in column.to_pylist()], pa.string())
                elif name in lists:
                    column = pa.array([v and [x and rewrite.java_pattern(x) for x in v] for v in column.to_pylist()], pa.list_(pa.string()))
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, df.schema)


def _with_text(df: DataFrame, pattern: str) -> DataFrame:
    """Add ``text``, what every match of the pattern contains."""
    names = [*df.columns, "text"]

    def run(batches):
        for batch in batches:
            texts = [rewrite.required_literal(p) if p else None for p in batch.column(names.index(pattern)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, text string")


def checked_rules(rules: DataFrame) -> DataFrame:
    """Rules in the engine's syntax with ``reason``: why a rule cannot be used, NULL if it can.

    The same rules are rejected as by ``check_rules`` (a missing group counts as a bad target); patterns and replacements are tried
    out inside the tasks.
    """
    rows = rules.select(
        F.col("rule_id").cast("int").alias("rule_id"), F.col("ord").cast("int").alias("ord"), "domain", "link", "img", "to", "res",
        F.coalesce(F.col("to").startswith(":"), F.lit(False)).alias("code"),
    )
    rows = _translated(rows, ["link", "img"], ["to"], ["res"], target=lambda t: t if t.startswith(":") else rewrite.rule_target(t))

    def given(c):
        return F.coalesce(F.col(c) != "", F.lit(False))

    captures = F.forall(F.coalesce("res", F.array().cast("array<string>")), lambda p: _replaces(p, F.lit("$1")))
    both = given("img") & given("to")
    reason = (
        F.when(~captures, "bad res pattern")
        .when(given("img") & ~_compiles(F.col("img")), "bad img pattern")
        .when(given("link") & ~_compiles(F.col("link")), "bad link pattern")
        .when(F.col("code"), "code target")
        .when(both & ~_replaces(F.col("img"), F.col("to")), "bad target")
    )
    return rows.withColumn("reason", reason).drop("code")


def _pieces(low: Column, size: int) -> Column:
    """All substrings of a length."""
    return F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def _filed(df: DataFrame) -> DataFrame:
    """Rows with a ``text``, each under its rarest ``piece``."""
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    n = F.length("text")
    cut = F.when(n >= PIECES[0], _pieces(F.col("text"), PIECES[0])).otherwise(_pieces(F.col("text"), PIECES[1]))
    found = rows.select("_row", F.explode(F.array_distinct(cut)).alias("piece"))
    rare = found.join(found.groupBy("piece").agg(F.count("*").alias("n")), "piece")
    best = rare.groupBy("_row").agg(F.min(F.struct("n", "piece")).alias("b")).select("_row", "b.piece")
    return cut_lineage(rows.join(best, "_row").drop("_row"))


def _small(index: DataFrame) -> bool:
    """Whether the counted size of an index (a stored table) is at most ``BROADCAST_BYTES``.

    Estimates are not asked: they know nothing of exploded rows.
    """
    texts = [F.octet_length(c) for c, t in index.dtypes if t == "string"]
    size = F.sum(reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in texts], F.lit(64)))
    return (index.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def _lookup(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows with the entries of an index of the same key: a small index travels to all tasks, else both sides are sorted."""
    if _small(index):
        return rows.join(F.broadcast(index), key)
    return rows.hint("merge").join(index, key)


def _met(subjects: DataFrame, low: Column, filed: DataFrame) -> DataFrame:
    """Subjects, distinct rows, with the filed rows whose text they contain.

    Against a large index a subject is sent out once for each of its pieces, so it travels as two 64-bit hashes: of the row and
    of the piece.  What is met that way is few, and is compared as a whole.
    """
    sizes = [r[0] for r in filed.select(F.length("piece")).distinct().collect()]  # at most as many as PIECES
    cut = F.array_distinct(F.concat(*[_pieces(F.col("_low"), k) for k in sorted(sizes) or PIECES]))
    rows = subjects.withColumn("_low", low)
    if _small(filed):
        found = rows.withColumn("piece", F.explode(cut)).join(F.broadcast(filed), "piece")
    else:
        hashed = F.array_distinct(F.transform(cut, lambda p: F.xxhash64(p)))
        rows = rows.withColumn("_key", F.xxhash64(*subjects.columns))
        sent = rows.select("_key", F.explode(hashed).alias("_piece")).hint("merge")
        met = sent.join(filed.withColumn("_piece", F.xxhash64("piece")), "_piece").drop("_piece")
        found = rows.hint("merge").join(met, "_key").drop("_key")
    return found.filter(F.col("_low").contains(F.col("text"))).drop("piece", "text", "_low")


def _chunks(df: DataFrame, order: list[str], chunk: int):
    """Rows of a small table, a bounded number at a time."""
    last, kinds = None, dict(df.dtypes)
    place = F.struct(*order)

    def at(values):
        return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, values)])

    while True:
        left = df if last is None else df.filter(place > at(last))
        edge = left.select(place.alias("p")).orderBy("p").limit(chunk).agg(F.max("p")).first()[0]
        if edge is None:
            return
        last = list(edge)
        # with the edge come all rows of the same place, as several files have them
        yield [r.asDict(recursive=True) for r in left.filter(place <= at(last)).orderBy(*order).collect()]


def _host_keys() -> Column:
    """Hosts a URL is looked up by, with their tier."""
    page, image = U.get_domain("page_url"), U.get_domain("url")

    def keys(host, tier):
        short = F.when(host.startswith("www."), F.substring(host, 5, 10000))
        return [
            F.struct(F.lit(tier).alias("tier"), host.alias("domain")),
            F.struct(F.lit(tier + 1).alias("tier"), short.alias("domain")),
        ]

    other = F.when(image != page, image)
    return F.filter(F.array(*keys(page, 0), *keys(other, 2)), lambda k: k["domain"].isNotNull() & (k["domain"] != ""))


class RuleIndex:
    """Checked and indexed rules and site patterns; see the module.

    ``rules`` as ``index_rules`` gives them.  ``patterns``: site, domains, url_patterns, replacements and, for their order, ``ord``
    (else the order of the rows).  ``thumbnails``: (source, target) pairs, tried where nothing else applied.
    """

    def __init__(self, rules: DataFrame | None, patterns: DataFrame | None = None, thumbnails=(), chunk: int = CHUNK):
        self.chunk, self.thumbnails = chunk, list(thumbnails)
        self.rejects = None
        self.bound = self.filed = self.everywhere = self.patterns = None
        if rules is not None:
            checked = cut_lineage(checked_rules(rules))
            self.rejects = checked.filter("reason IS NOT NULL").select("rule_id", "ord", "reason")
            rows = checked.filter("reason IS NULL AND img <> '' AND to <> ''").select("ord", "rule_id", "domain", "img", "to")
            self.bound = rows.filter("domain IS NOT NULL")
            texts = cut_lineage(_with_text(rows.filter("domain IS NULL").drop("domain"), "img"))
            self.filed = _filed(texts.filter("text IS NOT NULL"))
            self.everywhere = texts.filter("text IS NULL").drop("text")
        if patterns is not None:
            self._add_patterns(patterns)

    # -- rules --

    def hits(self, urls: DataFrame) -> DataFrame:
        """Variants that the rules give, with their place: page_url, url, tier, ord, rule_id, pos, variant.

        Rules are tried on the column ``first`` if there is one, and looked up by the host of ``url``.
        """
        subject = "first" if "first" in urls.columns else "url"
        pairs = urls.select("page_url", "url", F.col(subject).alias("_on")).distinct()
        place = ["page_url", "url", "tier", "ord", "rule_id"]

        def variants(found: DataFrame) -> DataFrame:
            each = expand_variants(substitute("_on", F.col("img"), F.col("to")))
            return found.select(*place, F.posexplode(each).alias("pos", "variant"))

        out = variants(_lookup(pairs.select("*", F.inline(_host_keys())), self.bound, "domain"))
        out = out.unionByName(variants(_met(pairs, F.lower("_on"), self.filed).withColumn("tier", F.lit(4))))
        kind = "array<struct<ord:int,rule_id:int,img:string,to:string>>"
        for rows in _chunks(self.everywhere, ["ord", "rule_id"], self.chunk):
            some = F.filter(_constant(rows, kind), lambda r: rewrite.rule_hit("_on", r["img"]))
            tried = pairs.select("page_url", "url", "_on", F.lit(4).alias("tier"), F.inline(some))
            out = out.unionByName(variants(tried))
        return out

    # -- site patterns --

    def _add_patterns(self, patterns: DataFrame) -> None:
        order = F.col("ord") if "ord" in patterns.columns else F.monotonically_increasing_id()
        rows = cut_lineage(patterns.select(order.cast("bigint").alias("place"), "site", "domains", "url_patterns", "replacements"))
        self.patterns = rows.select("place", "site")
        self.domains = cut_lineage(rows.select("place", F.explode("domains").alias("domain")).select("place", F.lower("domain").alias("domain")).distinct())
        regexes = _translated(rows.select("place", F.explode("url_patterns").alias("img")), ["img"], [])
        texts = cut_lineage(_with_text(regexes.filter(_compiles(F.col("img"))), "img"))
        self.filed_sites = _filed(texts.filter("text IS NOT NULL"))
        self.sites_everywhere = texts.filter("text IS NULL").drop("text")
        steps = rows.select("place", F.posexplode("replacements").alias("step", "r")).select("place", "step", "r.source", "r.target")
        steps = _translated(steps, ["source"], ["target"], target=rewrite.python_target)
        self.steps = cut_lineage(steps.filter(_replaces(F.col("source"), F.col("target"))))

    def _sites_of(self, texts: DataFrame) -> DataFrame:
        """(u, place) of the site patterns that apply to each URL ``u``."""
        low = texts.select("u", F.lower("u").alias("low")).withColumn("host", U.get_domain("low"))
        lengths = [r[0] for r in self.domains.select(F.length("domain")).distinct().collect()]  # of host names
        parts = []
        if lengths:
            hosts = low.select("host").distinct()
            cut = [F.array(F.lit("")) if k == 0 else _pieces(F.col("host"), k) for k in sorted(lengths)]
            named = _lookup(hosts.select("host", F.explode(F.array_distinct(F.concat(*cut))).alias("domain")), self.domains, "domain")
            parts.append(low.select("u", "host").hint("merge").join(named.select("host", "place").distinct(), "host").select("u", "place"))
        met = _met(low.select("u", "low"), F.col("low"), self.filed_sites)
        parts.append(met.filter(F.rlike("low", F.concat(F.lit("(?i)"), "img"))).select("u", "place"))
        for rows in _chunks(self.sites_everywhere, ["place", "img"], self.chunk):
            tests = _constant(rows, "array<struct<place:bigint,img:string>>")
            hit = F.filter(tests, lambda p: F.rlike("low", F.concat(F.lit("(?i)"), p["img"])))
            parts.append(low.select("u", F.explode(F.transform(hit, lambda p: p["place"])).alias("place")))
        return reduce(DataFrame.unionByName, parts).distinct()

    def matches(self, urls: DataFrame) -> DataFrame:
        """(page_url, url, place) of the site patterns of each URL, else of its page."""
        pairs = cut_lineage(urls.select("page_url", "url").distinct())
        texts = pairs.select(F.col("url").alias("u")).union(pairs.select("page_url")).filter("u IS NOT NULL").distinct()
        found = cut_lineage(self._sites_of(texts))
        pairs = pairs.hint("merge")
        own = pairs.join(found, F.col("url") == F.col("u")).select("page_url", "url", "place")
        rest = pairs.join(found.select("u").distinct(), F.col("url") == F.col("u"), "left_anti")
        return own.unionByName(rest.hint("merge").join(found, F.col("page_url") == F.col("u")).select("page_url", "url", "place"))

    def match_sites(self, urls: DataFrame) -> DataFrame:
        """One row per distinct URL of a page and matching site."""
        return self.matches(urls).join(self.patterns, "place").select("page_url", "url", "site")

    def replaced(self, urls: DataFrame) -> DataFrame:
        """Distinct (page_url, url) with ``first``: the URL after the ordered replacements of its site patterns."""
        steps = self.matches(urls).hint("merge").join(self.steps, "place")
        steps = steps.select("page_url", "url", F.struct("place", "step", "source", "target").alias("s"))
        none = F.lit(None).cast(steps.schema["s"].dataType).alias("s")
        rows = urls.select("page_url", "url", none).unionByName(steps).groupBy("page_url", "url")
        rows = rows.agg(F.array_sort(F.collect_list("s")).alias("steps"))
        return rows.select("page_url", "url", apply_replacements("url", F.col("steps")).alias("first"))

    # -- the whole chain --

    def transform(self, urls: DataFrame) -> DataFrame:
        """Ordered distinct candidates of each distinct URL of a page: page_url, url, pos, candidate."""
        if self.patterns is None:
            rows = urls.select("page_url", "url").distinct().withColumn("first", F.col("url"))
        else:
            rows = self.replaced(urls)
        rows = cut_lineage(rows)
        if self.bound is None:
            rows = rows.withColumn("more", F.array().cast("array<string>"))
        else:
            found = self.hits(rows).select(
                "page_url", "url", F.lit(None).cast("string").alias("first"), F.struct("tier", "ord", "rule_id", "pos", "variant").alias("v")
            )
            none = F.lit(None).cast(found.schema["v"].dataType).alias("v")
            rows = rows.select("page_url", "url", "first", none).unionByName(found).groupBy("page_url", "url")
            rows = rows.agg(F.max("first").alias("first"), F.array_sort(F.collect_list("v")).alias("v"))
            rows = rows.withColumn("more", F.transform("v", lambda x: x["variant"]))
        pairs = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in self.thumbnails]
        thumb = apply_replacements("url", F.array(*pairs)) if pairs else F.col("url")
        rows = rows.withColumn("thumb", thumb)
        found = (
            F.when((F.col("first") != F.col("url")) | (F.size("more") > 0), F.concat(F.array("first"), "more"))
            .when(F.col("thumb") != F.col("url"), F.array("thumb"))
            .otherwise(F.array(strip_size_suffix("first")))
        )
        return rows.select("page_url", "url", F.posexplode(F.array_distinct(found)).alias("pos", "candidate"))
