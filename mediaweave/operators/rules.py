"""Rule tables: checking, matching and rewriting in bulk."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.functions import urls as U
from mediaweave.functions.rewrite import RuleBook, apply_replacements, java_pattern, python_target, rule_target
from mediaweave.operators.ruleindex import CHUNK, RuleIndex


def rule_domain(regex) -> Column:
    """Plain host named at the start of a rule's pattern, lower-cased."""
    hit = F.regexp_extract(
        U.col(regex), r"(?i)\^?\s*\(?\s*(?:www\.)?([a-z0-9-]+(?:\\[.][a-z0-9-]+)+)", 1
    )
    return F.nullif(F.lower(F.replace(hit, F.lit("\\."), F.lit("."))), F.lit(""))


def index_rules(rules: DataFrame) -> DataFrame:
    """Add the host a rule is bound to, from ``link`` or else ``img``; NULL means global."""
    return rules.withColumn("domain", F.coalesce(rule_domain("link"), rule_domain("img")))


def res_patterns(rules: DataFrame) -> DataFrame:
    """Rules that can capture from a linked page: they have ``link`` and ``res``."""
    usable = (F.coalesce(F.col("link"), F.lit("")) != "") & (F.size(F.coalesce("res", F.array().cast("array<string>"))) > 0)
    return rules.filter(usable).select("rule_id", "ord", "name", "link", "res")


def _groups(spark: SparkSession, pattern: str) -> int:
    """Number of groups of a pattern, -1 when it does not compile on the JVM."""
    try:
        return spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception:
        return -1


def _fault(spark: SparkSession, pattern: str, target: str | None = None) -> str | None:
    """Why a pattern, or a replacement by it, cannot be used; tried out on the JVM."""
    groups = _groups(spark, pattern)
    if groups < 0:
        return "pattern"
    if target is not None:
        named = [int(n) for n in re.findall(r"(?<!\\)\$(\d)", target)]
        if named and max(named) > groups:
            return "group"
        # the pattern or nothing: every replacement is carried out at least once, on an empty text
        jvm = spark._jvm.java.util.regex.Pattern
        try:
            jvm.compile(f"(?:{pattern})|").matcher("").replaceAll(target)
        except Exception:
            return "target"
    return None


def check_rules(spark: SparkSession, rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Split rules into usable ones, in the engine's syntax, and rejects with a reason.

    Rejected: patterns that do not compile, targets naming a missing group or failing a trial, targets
    holding program code instead of a substitution.
    """
    good, bad = [], []
    for row in rows:
        new = {**row, "link": row.get("link") and java_pattern(row["link"]), "img": row.get("img") and java_pattern(row["img"])}
        new["res"] = [java_pattern(p) for p in row["res"]] if row.get("res") else row.get("res")
        reason, to = None, row.get("to") or ""
        if to.startswith(":"):
            reason = "code target"
        elif to:
            new["to"] = rule_target(to)
        for key in ("link", "img"):
            if new[key] and _fault(spark, new[key]):
                reason = f"bad {key} pattern"
        for pattern in new["res"] or []:
            if _groups(spark, pattern) < 1:
                reason = "bad res pattern"
        if not reason and new["img"] and to:
            reason = {"group": "missing group", "target": "bad target"}.get(_fault(spark, new["img"], new["to"]))
        good.append(new) if not reason else bad.append({**row, "reason": reason})
    return good, bad


def check_replacements(spark: SparkSession, pairs) -> tuple[list[tuple[str, str]], list[dict]]:
    """Split Python-style (source, target) replacements into usable ones, in the engine's syntax, and rejects."""
    good, bad = [], []
    for source, target in pairs:
        new = java_pattern(source), python_target(target)
        fault = _fault(spark, *new)
        if fault:
            bad.append({"source": source, "target": target, "reason": {"group": "missing group"}.get(fault, f"bad {fault}")})
        else:
            good.append(new)
    return good, bad


def rule_book(rules: DataFrame, patterns: DataFrame | None = None, thumbnails=()) -> RuleBook:
    """Fold checked rule rows into a book; ``rejects`` of the book lists what cannot be used, and why.

    Rules and patterns are configuration: files that a person keeps.  Tables of another order of size go through
    ``apply_rules_by_join``.
    """
    spark = rules.sparkSession
    good, bad = check_rules(spark, [r.asDict(recursive=True) for r in rules.orderBy("ord", "rule_id").collect()])
    rejects = [{"kind": "rule", "name": str(r["rule_id"]), "reason": r["reason"]} for r in bad]
    sites = []
    for p in patterns.collect() if patterns is not None else []:
        pairs, faulty = check_replacements(spark, [(x["source"], x["target"]) for x in p["replacements"] or []])
        rejects += [{"kind": "replacement", "name": p["site"], "reason": r["reason"]} for r in faulty]
        urls = []
        for rx in map(java_pattern, p["url_patterns"] or []):
            if _fault(spark, rx):
                rejects.append({"kind": "site pattern", "name": p["site"], "reason": "bad pattern"})
            else:
                urls.append(rx)
        sites.append({**p.asDict(), "url_patterns": urls, "replacements": pairs})
    pairs, faulty = check_replacements(spark, thumbnails)
    rejects += [{"kind": "thumbnail", "name": r["source"], "reason": r["reason"]} for r in faulty]
    return RuleBook(rules=good, patterns=sites, thumbnails=pairs, rejects=rejects)


def rejected(spark: SparkSession, book: RuleBook) -> DataFrame:
    """Rules, replacements and patterns that were left out, with the reason."""
    return spark.createDataFrame([(r["kind"], r["name"], r["reason"]) for r in book.rejects], "kind string, name string, reason string")


def match_site_patterns(urls: DataFrame, book: RuleBook) -> DataFrame:
    """Sites whose pattern applies to the URL, else to its page: one row per match."""
    steps = []

    def tests(u):
        low = F.lower(F.col(u))
        host = U.get_domain(low)
        out = []
        for p in book.patterns:
            test = F.lit(False)
            for d in p.get("domains") or []:
                test = test | host.contains(d.lower())
            for rx in p.get("url_patterns") or []:
                test = test | low.rlike("(?i)" + rx)
            out.append(test)
        return out

    def sites(found):
        named = F.array(*[F.when(t, F.lit(p["site"])) for t, p in zip(found, book.patterns)])
        return F.filter(named, lambda s: s.isNotNull())

    on_url = sites(tests("url"))
    steps = F.when(F.size(on_url) > 0, on_url).otherwise(sites(tests("page_url")))
    return urls.select("page_url", "url", F.explode(steps).alias("site"))


def replace_by_site(urls: DataFrame, book: RuleBook) -> DataFrame:
    """URLs after the ordered replacements of their site patterns."""
    pairs = book.site_replacements("url", "page_url")
    return urls.withColumn("replaced_url", apply_replacements("url", pairs))


def rule_candidates(urls: DataFrame, book: RuleBook) -> DataFrame:
    """Ids of the rules to try for each URL, in order."""
    found = book.rules_for_hosts("page_url", "url")
    return urls.withColumn("candidates", F.transform(found, lambda r: r["rule_id"]))


def apply_rules(urls: DataFrame, book: RuleBook) -> DataFrame:
    """Every variant every matching rule gives, one row each, in order."""
    variants = book.apply_rules(F.col("url"), F.col("page_url"))
    return urls.select("page_url", "url", F.posexplode(variants).alias("pos", "variant"))


def apply_rules_by_join(urls: DataFrame, rules: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Same result as ``apply_rules`` for rule tables too large to fold into a plan, with each variant's place."""
    return RuleIndex(rules, chunk=chunk).hits(urls)


def transform_image_urls(urls: DataFrame, book: RuleBook) -> DataFrame:
    """Ordered distinct candidates of each image URL, one row each."""
    return urls.select("page_url", "url", F.posexplode(book.transform("url", "page_url")).alias("pos", "candidate"))


def rule_function(fn: Column, args: Column) -> Column:
    """Small fixed set of operations that rule data may name.

    ``args`` is an array of strings: group and concat join their arguments,
    ``if`` picks the second or third by the first, ``replace`` substitutes a
    literal, ``base64`` and ``urldecode`` decode.
    """
    a = [F.get(args, n) for n in range(3)]
    return (
        F.when(fn == "group", a[0])
        .when(fn == "concat", F.array_join(args, ""))
        .when(fn == "if", F.when(F.coalesce(a[0], F.lit("")) != "", a[1]).otherwise(a[2]))
        .when(fn == "replace", F.regexp_replace(a[0], a[1], a[2]))
        .when(fn == "base64", F.decode(F.unbase64(a[0]), "UTF-8"))
        .when(fn == "urldecode", F.try_url_decode(F.replace(a[0], F.lit("+"), F.lit("%2B"))))
    )


def rule_counts(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Number of rules (bound, global) and of site patterns."""
    by_kind = rules.select(
        F.lit("rule").alias("kind"), F.when(F.col("domain").isNull(), "global").otherwise("host").alias("scope")
    )
    sites = patterns.select(F.lit("pattern").alias("kind"), F.lit("site").alias("scope"))
    return by_kind.unionByName(sites).groupBy("kind", "scope").agg(F.count("*").alias("n"))
