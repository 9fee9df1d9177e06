"""Browser-side view of a page: scan, full-size discovery through linked pages, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaweave import constants as K
from mediaweave.functions import urls as U
from mediaweave.functions.rewrite import RuleBook, _constant, largest_srcset, required_literal
from mediaweave.functions.urls import let

_IMAGE_LINK = r"(?i)\.(?:jpe?g|png|gif|webp|bmp|tiff?|avif|heic)(?:\?|$)"
_SAVED_IMAGE = r"(?i)\.(?:jpe?g|webp|avif|heic|bmp|tiff?)$"
_HIT = "array<struct<stage:int,kind:string,ref:string,source:string,width:bigint,height:bigint,alt:string>>"


def _hit(stage: int, kind: str, ref: Column, source: str, condition: Column, sized: bool = False) -> Column:
    attrs = F.col("attrs")

    def side(name):
        return F.coalesce(U.as_int(attrs[name]), F.lit(0)) if sized else F.lit(None).cast("bigint")

    value = F.struct(
        F.lit(stage).alias("stage"),
        F.lit(kind).alias("kind"),
        ref.alias("ref"),
        F.lit(source).alias("source"),
        side("width").alias("width"),
        side("height").alias("height"),
        (F.coalesce(attrs["alt"], F.lit("")) if sized else F.lit(None).cast("string")).alias("alt"),
    )
    return F.when(F.coalesce(condition & (ref != ""), F.lit(False)), value)


def _followable(href: Column) -> Column:
    return ~href.rlike("^(?:#|javascript:)")


def scan_page(node_table: DataFrame) -> DataFrame:
    """Media a browser sees on each page; the first sighting of a URL wins."""
    a, tag = F.col("attrs"), F.col("tag")
    lazy = F.coalesce(*[F.nullif(a[n], F.lit("")) for n in ("data-src", "data-original", "data-full")])
    css = F.regexp_extract(a["style"], r"""url\(["']?(https?://[^"')]+)["']?\)""", 1)
    hits = F.array(
        _hit(0, "image", a["src"], "img", tag == "img", sized=True),
        _hit(0, "image", largest_srcset(a["srcset"], browser=True), "srcset", tag == "img"),
        _hit(0, "image", lazy, "data-src", (tag == "img") & lazy.rlike("^(?:http|//)")),
        _hit(1, "image", a["href"], "a-link", (tag == "a") & _followable(a["href"])),
        _hit(2, "video", a["src"], "video", tag == "video"),
        _hit(2, "video", a["src"], "source", (tag == "source") & F.col("video_id").isNotNull()),
        _hit(
            3, "image", largest_srcset(a["srcset"], browser=True), "picture",
            (tag == "source") & F.col("picture_id").isNotNull(),
        ),
        _hit(4, "image", css, "css", a["style"].contains("background-image")),
        _hit(
            5, "image", a["content"], "meta",
            (tag == "meta")
            & (F.coalesce(a["property"] == "og:image", F.lit(False)) | F.coalesce(a["name"] == "twitter:image", F.lit(False))),
        ),
    )
    present = F.filter(hits, lambda h: h.isNotNull()).cast(_HIT)
    resolved = F.transform(
        present, lambda h, i: F.struct(h.alias("h"), i.alias("pos"), U.url_join("page_url", h["ref"]).alias("url"))
    )
    rows = node_table.select("page_id", "page_url", "node_id", F.explode(resolved).alias("m"))
    url, h = F.col("m.url"), F.col("m.h")
    linked = h["source"] == "a-link"
    tiny = (h["width"] > 0) & (h["height"] > 0) & (h["width"] < 50) & (h["height"] < 50)
    kept = rows.filter(
        ~U.is_junk_url(url)
        & ~F.coalesce(tiny, F.lit(False))
        & (~linked | (url.rlike(_IMAGE_LINK) & (url != F.col("page_url"))))
    )
    order = F.struct(h["stage"], "node_id", "m.pos")
    first = kept.groupBy("page_id", "page_url", url.alias("url")).agg(F.min_by("m.h", order).alias("h"))
    return first.select(
        "page_id", "page_url", "url", F.col("h.kind").alias("media_type"), "h.source", "h.width", "h.height", "h.alt"
    )


def scan_links(node_table: DataFrame) -> DataFrame:
    """Pages a browser scan would look into, with their order of discovery."""
    href = F.col("attrs")["href"]
    above = F.col("anchor_attrs")["href"]
    target = (
        F.when((F.col("tag") == "img") & above.isNotNull() & (above != "") & (above != "#")
               & ~above.startswith("javascript:"), F.struct(F.lit(0).alias("stage"), above.alias("ref")))
        .when((F.col("tag") == "a") & (href != "") & _followable(href),
              F.struct(F.lit(1).alias("stage"), href.alias("ref")))
    )
    found = node_table.filter(F.col("tag").isin("img", "a")).select(
        "page_id", "page_url", "node_id", target.alias("t")
    )
    rows = found.filter(F.col("t").isNotNull()).select(
        "page_id", "page_url", "node_id", "t.stage", F.explode(F.array(U.url_join("page_url", "t.ref"))).alias("url")
    )
    kept = rows.filter((F.col("url") != F.col("page_url")) & ((F.col("stage") == 0) | ~F.col("url").rlike(_IMAGE_LINK)))
    return kept.groupBy("page_id", "page_url", "url").agg(F.min(F.struct("stage", "node_id")).alias("first_seen"))


def cap_links(links: DataFrame, limit: int = K.MAX_LINKED_PAGES) -> DataFrame:
    """First ``limit`` links of each page."""
    w = W.partitionBy("page_id").orderBy("first_seen", "url")
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def img_sources(html: Column) -> Column:
    """Image file URLs of raw ``<img src>`` markup, in order, without repeats."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), 1)
    whole = F.transform(found, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    return F.array_distinct(F.filter(whole, lambda u: u.startswith("http") & u.rlike(_SAVED_IMAGE)))


def img_src_regex(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.posexplode(img_sources(F.col("html"))).alias("pos", "img_url"))


def _captures(url: Column, html: Column, rules: RuleBook) -> Column:
    """First rule whose ``link`` hits the URL and whose ``res`` captures something in the page."""
    bare = F.regexp_replace(url, r"^https?://", "")

    def full(u):
        return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https:"), u))

    none = F.array().cast("array<string>")
    usable = [{"link": r["link"], "res": r["res"]} for r in rules.rules if r.get("link") and r.get("res")]
    if not usable:
        return none
    # the rules are one constant, however many there are
    table = _constant(usable, "array<struct<link:string,res:array<string>>>")
    hits = F.filter(table, lambda r: F.rlike(bare, F.concat(F.lit("(?i)"), r.link)) | F.rlike(url, F.concat(F.lit("(?i)"), r.link)))

    def captured(r):
        one = F.transform(
            r.res, lambda p: F.nullif(F.call_function("regexp_extract", html, F.concat(F.lit("(?i)"), p), F.lit(1)), F.lit(""))
        )
        return F.array_distinct(F.transform(F.filter(one, lambda x: x.isNotNull()), full))

    found = F.filter(F.transform(hits, captured), lambda f: F.size(f) > 0)
    return F.coalesce(F.get(found, 0), none)


def fullsize_of_pages(pages: DataFrame, rules: RuleBook) -> DataFrame:
    """What each linked page would yield; computed once per page, before the join to links."""
    html, url = F.col("html"), F.col("url")
    found = pages.select(
        "page_id",
        U.normalize_url("url").alias("norm"),
        _captures(url, html, rules).alias("captured"),
        F.filter(img_sources(html), lambda u: u != url).alias("images"),
    )
    # pages whose URLs normalise alike are one page: the first of them answers
    first = found.groupBy("norm").agg(F.min_by(F.struct("captured", "images"), "page_id").alias("p"))
    return first.select("norm", "p.captured", "p.images")


def discover_fullsize(links: DataFrame, pages: DataFrame, rules: RuleBook) -> DataFrame:
    """Full-size media behind the links of a page, first sighting per page.

    ``links`` is capped per page already.  The raw text is reduced to short
    arrays before the equi join, so ``html`` is never shuffled.
    """
    direct = links.filter(F.col("url").rlike(_IMAGE_LINK) | U.is_video_url("url"))
    as_direct = direct.select(
        "page_id", "page_url", "rank", F.lit(0).alias("kind_rank"), F.lit(0).alias("pos"), "url",
        F.when(U.is_video_url("url"), "video").otherwise("image").alias("media_type"), F.lit("link-direct").alias("source"),
    )
    joined = links.select("page_id", "page_url", "rank", F.col("url").alias("link"), U.normalize_url("url").alias("norm")).join(
        fullsize_of_pages(pages, rules), "norm"
    )

    def from_array(name, kind_rank, source):
        return joined.select(
            "page_id", "page_url", "rank", F.lit(kind_rank).alias("kind_rank"), F.posexplode(name).alias("pos", "url")
        ).withColumns({"media_type": F.lit("image"), "source": F.lit(source)})

    rows = as_direct.unionByName(from_array("captured", 1, "sieve-res")).unionByName(
        from_array("images", 2, "linked-img")
    )
    order = F.struct("rank", "kind_rank", "pos")
    return (
        rows.groupBy("page_id", "page_url", "url")
        .agg(F.min_by(F.struct("media_type", "source"), order).alias("m"))
        .select("page_id", "page_url", "url", "m.media_type", "m.source")
    )


def resolve_url(items: DataFrame, pages: DataFrame, rules: RuleBook) -> DataFrame:
    """Replace a page URL by what the first rule captures on that page."""
    found = pages.select(
        "page_id",
        U.normalize_url("url").alias("norm"),
        F.get(_captures(F.col("url"), F.col("html"), rules), 0).alias("resolved"),
    )
    target = found.groupBy("norm").agg(F.min_by("resolved", "page_id").alias("resolved"))
    return (
        items.withColumn("norm", U.normalize_url("url"))
        .join(target, "norm", "left")
        .withColumn("resolved_url", F.coalesce("resolved", "url"))
        .drop("norm", "resolved")
    )


def first_rule(url: Column, page_url: Column, rules: RuleBook) -> Column:
    """Browser form of rewriting: first rule giving another URL, first option of each block."""
    rows = [{"link": r.get("link"), "img": r["img"], "to": r["to"], "text": required_literal(r["img"])} for r in rules.rewriting]
    if not rows:
        return F.lit(None).cast("string")
    table = _constant(rows, "array<struct<link:string,img:string,to:string,text:string>>")

    def any_case(p):
        return F.concat(F.lit("(?i)"), p)

    def hits(low):
        return F.filter(
            table,
            lambda r: (r.text.isNull() | low.contains(r.text))
            & F.rlike(url, any_case(r.img))
            & (r.link.isNull() | F.rlike(page_url, any_case(r.link))),
        )

    def rewritten(r):
        # the match alone is substituted into the target, the rest of the URL is dropped
        whole = F.concat(F.lit("(?is)^.*?(?:"), r.img, F.lit(").*$"))
        return let(F.call_function("regexp_replace", url, whole, r.to), first_option)

    def first_option(value):
        options = F.trim(F.regexp_extract(value, r"#([^#]+)#", 1))
        return F.when(
            options != "",
            F.concat(
                F.regexp_extract(value, r"(?s)^(.*?)#[^#]+#", 1),
                F.regexp_extract(options, r"^(\S+)", 1),
                F.regexp_extract(value, r"(?s)^.*?#[^#]+#(.*)$", 1),
            ),
        ).otherwise(value)

    made = F.transform(let(F.lower(url), hits), rewritten)
    return F.get(F.filter(made, lambda v: (v != "") & (v != url)), 0)


def transform_media(items: DataFrame, rules: RuleBook) -> DataFrame:
    """Rewrite items by the first fitting rule, one row per newline-separated result."""
    changed = items.withColumn("result", F.explode(F.array(first_rule(F.col("url"), F.col("page_url"), rules))))
    parts = F.filter(F.split("result", "\n"), lambda p: F.trim(p) != "")
    rows = changed.withColumn("part", F.explode(F.coalesce(parts, F.array(F.lit(None).cast("string")))))
    return (
        rows.withColumn("original", F.when(F.col("part").isNotNull(), F.col("url")))
        .withColumn("transformed", F.col("part").isNotNull())
        .withColumn("url", F.coalesce(F.trim("part"), "url"))
        .drop("result", "part")
    )


def is_fullsize() -> Column:
    return F.col("source").isin(K.FULLSIZE_SOURCES)


def fullsize_or_all(items: DataFrame) -> DataFrame:
    """Full-size items of a page, or all of its items when it has none."""
    has = items.groupBy("page_id").agg(F.max(is_fullsize()).alias("has_full"))
    return items.join(has, "page_id").filter(~F.col("has_full") | is_fullsize()).drop("has_full")


def filter_items(items: DataFrame, host: str = "", view: str = "") -> DataFrame:
    """Items of a host, and of the full-size or thumbnail view."""
    out = items.filter(U.get_domain("url") == host) if host else items
    if view == "fullsize":
        return out.filter(is_fullsize())
    return out.filter(~is_fullsize()) if view == "thumbnail" else out
