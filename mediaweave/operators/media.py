"""Nodes to media and image-link records.

Each extractor is a Column: an array of candidates found on one node.  A node
row is exploded once, whatever number of extractors run on it, so extraction is
one narrow pass over the node table without a shuffle.  ``(stage, owner, pos)``
is the order in which a page yields its media; later first-wins steps use it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave import constants as K
from mediaweave.functions import urls as U
from mediaweave.functions.rewrite import RuleBook, parse_srcset
from mediaweave.operators.nodes import is_visible

_CANDIDATE = (
    "array<struct<stage:int,owner:int,pos:bigint,kind:string,ref:string,test:string,source:string,"
    "width:string,height:string,alt:string,cdn:string,transformed:boolean,original_url:string,"
    "attrs:map<string,string>>>"
)
_IMAGE_FILE = r"\.(?:jpg|jpeg|png|webp|gif|avif|tiff|bmp)"
_CSS_IMAGE_FILE = r"\.(?:jpg|jpeg|png|webp|gif|avif)"

STAGES = {
    "picture": 0, "img": 1, "css": 2, "icon": 3, "meta_image": 4, "video": 5, "embed": 6,
    "meta_video": 7, "jsonld": 8, "script": 9, "data": 10, "lazy": 11,
}


def _none() -> Column:
    return F.array().cast(_CANDIDATE)


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


_FIELDS = (
    "stage", "owner", "pos", "kind", "ref", "test", "source", "width", "height", "alt", "cdn", "transformed",
    "original_url", "attrs",
)


@functools.cache
def _constant(value, gateway: int) -> Column:
    """Literal shared by all expressions of a session: building one is a round trip to the JVM."""
    return F.lit(value)


def _c(value) -> Column:
    return value if isinstance(value, Column) else _constant(value, id(SparkContext._gateway))


def _candidate(
    stage, kind, ref, test="significant", source=None, owner=None, pos=0, width=None, height=None,
    alt=None, cdn=None, transformed=False, original=None, attrs=None,
) -> Column:
    values = (
        stage, F.col("node_id") if owner is None else owner, pos, kind, ref, test, source, width, height, alt, cdn,
        transformed, original, F.create_map(*map(_c, attrs)) if attrs else None,
    )
    return F.named_struct(*[_c(x) for pair in zip(_FIELDS, values) for x in pair])


def _on(condition: Column, candidates: Column) -> Column:
    """Candidates of the rows meeting the condition, none for the others."""
    return F.when(F.coalesce(condition, F.lit(False)), candidates.cast(_CANDIDATE)).otherwise(_none())


# --- best image of an <img> --------------------------------------------------


def _hires(name: str) -> bool:
    return any(w in name for w in K.HIRES_ATTRIBUTE_WORDS)


@dataclass(frozen=True)
class Settings:
    """What a task may set of the extraction: smallest image, and whether hidden links count."""

    min_width: int = K.MIN_IMAGE_WIDTH
    min_height: int = K.MIN_IMAGE_HEIGHT
    filter_hidden: bool = True


DEFAULTS = Settings()


def best_image(attrs: Column, min_width: int = K.MIN_IMAGE_WIDTH, min_height: int = K.MIN_IMAGE_HEIGHT) -> Column:
    """Best candidate of an image's attributes as ``struct<url, rank, source, width, height>``."""

    def option(url, rank, source):
        return F.struct(
            url.alias("url"), (F.lit(rank) if isinstance(rank, int) else rank).cast("bigint").alias("rank"),
            (F.lit(source) if isinstance(source, str) else source).alias("source"),
        )

    named = [option(attrs[n], 100 if _hires(n) else 0, n) for n in K.IMAGE_ATTRIBUTES]
    sets = [
        F.transform(parse_srcset(attrs[n]), lambda s: option(s["url"], s["width"], "srcset"))
        for n in K.SRCSET_ATTRIBUTES
    ]
    hinted = U.any_of(K.HIRES_ATTRIBUTE_WORDS)
    entries = F.filter(
        F.coalesce(F.map_entries(attrs), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: (e["key"] != "class") & F.lower(e["value"]).rlike(_IMAGE_FILE),
    )
    anywhere = F.transform(
        entries, lambda e: option(e["value"], F.when(e["key"].rlike(hinted), 999999).otherwise(0), e["key"])
    )
    options = F.concat(F.filter(F.array(*named), lambda o: o["url"] != ""), *sets, anywhere)

    w, h = U.as_int(attrs["width"]), U.as_int(attrs["height"])
    sized = w.isNotNull() & h.isNotNull()
    bar = max(K.HIGH_QUALITY_SIDE, min_width * 2)

    def choose(v):
        big = v["sized"] & ((v["w"] > bar) | (v["h"] > bar))
        ranked = F.transform(
            v["options"],
            lambda o: option(
                o["url"], F.when((o["rank"] == 0) & big, F.greatest(v["w"], v["h"])).otherwise(o["rank"]), o["source"]
            ),
        )
        kept = F.filter(
            ranked,
            lambda o: ((o["rank"] >= min_width) & (o["rank"] > 0))
            | F.coalesce(v["sized"] & (v["h"] >= min_height), F.lit(False))
            | (o["rank"] == 0),
        )
        pool = F.when(F.size(kept) > 0, kept).otherwise(ranked)
        first = F.get(pool, 0)
        top = F.aggregate(pool, first, lambda acc, o: F.when(o["rank"] > acc["rank"], o).otherwise(acc))
        return F.struct(
            top["url"].alias("url"), top["rank"].alias("rank"), top["source"].alias("source"),
            F.when(v["sized"], v["w"]).alias("width"), F.when(v["sized"], v["h"]).alias("height"),
        )

    return U.let(F.struct(options.alias("options"), sized.alias("sized"), w.alias("w"), h.alias("h")), choose)


# --- extractors --------------------------------------------------------------


def picture_images(rules: RuleBook | None = None, settings: Settings = DEFAULTS) -> Column:
    rules = rules or RuleBook()
    inside = F.col("picture_id").isNotNull()
    from_sources = F.transform(
        parse_srcset(_attr("srcset")),
        lambda s, i: _candidate(
            STAGES["picture"], "image", s["url"], "sized", "srcset", F.col("picture_id"),
            F.col("node_id").cast("bigint") * 100000 + i, s["width"], cdn="img",
            attrs=[F.lit("media"), F.coalesce(_attr("media"), F.lit("")), F.lit("type"), F.coalesce(_attr("type"), F.lit(""))],
        ),
    )

    def from_image(best):
        urls = F.when(_filled(best["url"]), rules.transform(best["url"], F.col("page_url")))
        return F.transform(
            urls,
            lambda u, i: _candidate(
                STAGES["picture"], "image", u, "sized", "img", F.col("picture_id"),
                F.lit(1 << 50) + i, best["rank"], cdn="img",
                attrs=[F.lit("media"), F.lit(""), F.lit("type"), F.lit("")],
            ),
        )

    first_image = (F.col("tag") == "img") & F.col("first_of_kind")
    return F.concat(
        _on((F.col("tag") == "source") & inside, from_sources),
        _on(first_image, U.let(best_image(F.col("attrs"), settings.min_width, settings.min_height), from_image)),
    )


def _image_facts(rules: RuleBook, retry: bool, settings: Settings) -> Column:
    """Per rewritten variant of an image: its URL, whether it counts, and its linked target."""
    anchor, page = F.col("anchor_attrs"), F.col("page_url")
    linked = _filled(anchor["href"]) & is_visible(anchor, F.col("anchor_parent_attrs"))
    target = F.when(linked, U.url_join(page, anchor["href"]))
    alt = F.coalesce(_attr("alt"), F.lit(""))

    def with_target(v):
        t = v["target"]
        ok = F.coalesce(t.rlike("^https?://"), F.lit(False))
        return F.struct(
            v["best"].alias("best"),
            F.when(ok, t).alias("target"),
            F.when(ok, U.is_image_url(t)).alias("to_image"),
            F.when(ok, U.is_trash_media(t)).alias("to_trash"),
            F.when(ok, U.is_media_url(t) | t.rlike(U.any_of(K.FULLSIZE_LINK_WORDS))).alias("to_media"),
            F.when(ok, U.is_significant(t, alt=alt)).alias("to_significant"),
        )

    def per_variant(v):
        best = v["best"]
        urls = rules.transform(best["url"], page)

        def facts(u):
            def judge(a):
                kept = U.is_significant(a, alt=alt)
                return F.struct(
                    a.alias("url"),
                    ((kept | U.is_not_noise(a)) if retry else kept).alias("kept"),
                )

            return F.struct(
                U.let(U.url_join(page, u), judge).alias("v"),
                ((F.size(urls) > 1) | (u != best["url"])).alias("transformed"),
                *[v[n].alias(n) for n in ("best", "target", "to_image", "to_trash", "to_media", "to_significant")],
            )

        found = F.transform(urls, lambda u: facts(u))
        return F.filter(found, lambda f: f["v"]["url"].rlike("^https?://"))

    best = best_image(F.col("attrs"), settings.min_width, settings.min_height)
    bound = U.let(F.struct(best.alias("best"), target.alias("target")), with_target)
    variants = U.let(bound, lambda v: F.when(_filled(v["best"]["url"]), per_variant(v)))
    return F.when((F.col("tag") == "img") & is_visible(), variants)


def _to_page(f) -> Column:
    """The image counts and its link leads to a page, not to another image."""
    return F.coalesce(
        f["kept"] & f["target"].isNotNull() & (f["target"] != f["url"]) & ~f["to_image"] & ~f["to_trash"],
        F.lit(False),
    )


def _flat(f) -> dict:
    names = ("best", "target", "to_image", "to_trash", "to_media", "to_significant", "transformed")
    return {"url": f["v"]["url"], "kept": f["v"]["kept"], **{n: f[n] for n in names}}


def img_images(rules: RuleBook | None = None, retry: bool = False, settings: Settings = DEFAULTS) -> Column:
    """Media of visible images: the image, and the full-size file its link points at."""
    rules = rules or RuleBook()

    def emit(raw, i):
        f = _flat(raw)
        best = f["best"]
        sized = dict(width=best["width"], height=best["height"], alt=F.coalesce(_attr("alt"), F.lit("")))
        own = _candidate(
            STAGES["img"], "image", f["url"], "none", best["source"], pos=i.cast("bigint") * 2, cdn="img",
            transformed=f["transformed"], original=F.when(f["transformed"], best["url"]), **sized,
        )
        follow = F.lit(True) if not retry else (f["target"] != F.col("page_url"))
        goes = follow & f["to_significant"] & ~f["to_trash"]
        onward = _candidate(
            STAGES["img"], "image", f["target"], "none",
            F.when(f["to_image"], "parent-link").otherwise("fullsize-link"), pos=i.cast("bigint") * 2 + 1, **sized,
        )
        return F.concat(
            _on(f["kept"] & (~_to_page(f) | f["transformed"]), F.array(own)),
            _on(goes & (f["to_image"] | f["to_media"]), F.array(onward)),
        )

    return F.coalesce(F.flatten(F.transform(_image_facts(rules, retry, settings), emit)), _none())


_LINK = (
    "array<struct<owner:int,pos:bigint,url:string,thumbnail_url:string,priority:double,"
    "potential_media_container:boolean>>"
)


def img_links(rules: RuleBook | None = None, retry: bool = False, settings: Settings = DEFAULTS) -> Column:
    """Pages to crawl because an image links to them."""
    rules = rules or RuleBook()

    def emit(raw, i):
        f = _flat(raw)

        def link(pos, priority, container):
            return F.array(
                F.struct(
                    F.col("node_id").alias("owner"), (i.cast("bigint") * 2 + pos).alias("pos"),
                    f["target"].alias("url"), f["url"].alias("thumbnail_url"),
                    F.lit(priority).cast("double").alias("priority"),
                    F.lit(container).cast("boolean").alias("potential_media_container"),
                )
            )

        def on(condition, value):
            none = F.array().cast(_LINK)
            return F.when(F.coalesce(condition, F.lit(False)), value.cast(_LINK)).otherwise(none)

        follow = F.lit(True) if not retry else (f["target"] != F.col("page_url"))
        known = f["target"].isNotNull() & follow
        media_like = f["to_image"] | f["to_media"]
        return F.concat(
            on(_to_page(f) & follow, link(0, 15.0, None)),
            on(known & media_like & f["to_trash"], link(1, 10.0, None)),
            on(known & ~media_like & ~_to_page(f), link(1, 15.0, True)),
        )

    return F.coalesce(F.flatten(F.transform(_image_facts(rules, retry, settings), emit)), F.array().cast(_LINK))


def css_urls(style: Column) -> Column:
    found = F.regexp_extract_all(style, F.lit(r"""url\(["']?([^)"']+)["']?\)"""), 1)
    return F.filter(found, lambda u: F.lower(u).rlike(_CSS_IMAGE_FILE))


def css_images() -> Column:
    return _on(
        _attr("style").isNotNull(),
        F.transform(
            css_urls(_attr("style")),
            lambda u, i: _candidate(
                STAGES["css"], "image", u, source="css", pos=i, cdn="img", attrs=[F.lit("element"), F.col("tag")]
            ),
        ),
    )


def icon_images() -> Column:
    rel, sizes = _attr("rel"), F.coalesce(_attr("sizes"), F.lit(""))
    small = ~rel.contains("apple-touch-icon") & ((sizes == "") | sizes.rlike("16x16|32x32|48x48"))
    return _on(
        (F.col("tag") == "link") & rel.contains("icon") & _filled(_attr("href")),
        F.array(
            _candidate(
                STAGES["icon"], "image", _attr("href"), F.when(small, "significant").otherwise("none"),
                attrs=[F.lit("rel"), rel, F.lit("sizes"), sizes, F.lit("type"), F.coalesce(_attr("type"), F.lit(""))],
            )
        ),
    )


def _meta(stage: str, kind: str, words: str, test: str, cdn) -> Column:
    prop = _attr("property")
    return _on(
        (F.col("tag") == "meta") & prop.rlike(words) & _filled(_attr("content")),
        F.array(
            _candidate(
                STAGES[stage], kind, _attr("content"), test, "meta", cdn=cdn, attrs=[F.lit("property"), prop]
            )
        ),
    )


def meta_images() -> Column:
    return _meta("meta_image", "image", "og:image|twitter:image", "significant", "img")


def meta_videos() -> Column:
    return _meta("meta_video", "video", "og:video|twitter:player", "none", None)


def video_tags() -> Column:
    def found(video, owner, pos):
        return F.array(
            _candidate(
                STAGES["video"], "video", _attr("src"), "none", owner=owner, pos=pos,
                width=F.coalesce(video["width"], F.lit("")), height=F.coalesce(video["height"], F.lit("")), cdn="video",
                attrs=[F.lit("poster"), F.coalesce(video["poster"], F.lit("")),
                       F.lit("type"), F.coalesce(_attr("type"), F.lit(""))],
            )
        )

    has_src = _filled(_attr("src"))
    return F.concat(
        _on((F.col("tag") == "video") & has_src, found(F.col("attrs"), F.col("node_id"), 0)),
        _on(
            (F.col("tag") == "source") & F.col("video_id").isNotNull() & has_src,
            found(F.col("video_attrs"), F.col("video_id"), F.col("node_id")),
        ),
    )


def video_embeds() -> Column:
    src = F.when(_filled(_attr("src")), _attr("src")).otherwise(_attr("data-src"))
    return _on(
        (F.col("tag") == "iframe") & _filled(src),
        F.array(
            _candidate(
                STAGES["embed"], "video", src, "platform", "iframe", width=F.coalesce(_attr("width"), F.lit("")),
                height=F.coalesce(_attr("height"), F.lit("")), attrs=[F.lit("type"), F.lit("embed")],
            )
        ),
    )


_VARIANTS = "array<variant>"


def _get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f'$["{name}"]', kind)


def _starts_http(c: Column) -> Column:
    return F.coalesce(c.startswith("http"), F.lit(False))


def jsonld_media(most: int | None = K.JSONLD_LISTED) -> Column:
    """Media named by schema.org objects in JSON-LD scripts; of a list of images the first ``most``, or all if that is None."""
    hit = "struct<kind:string,url:string>"

    def pick(condition, kind, url):
        return F.when(condition & _starts_http(url), F.struct(F.lit(kind).alias("kind"), url.alias("url")))

    def read(obj):
        kinds = F.coalesce(_get(obj, "@type"), F.lit(""))
        image = _get(obj, "image", "variant")
        shape = F.coalesce(F.schema_of_variant(image), F.lit("MISSING"))
        text = F.when(shape == "STRING", _get(obj, "image"))
        has_image = image.isNotNull()
        images = _get(obj, "image", _VARIANTS)
        listed = F.coalesce(images if most is None else F.slice(images, 1, most), F.array().cast(_VARIANTS))
        is_image = kinds.contains("ImageObject")
        empty = ~has_image | shape.isin("VOID") | (text == "") | (shape == "ARRAY<VOID>") | (shape == "OBJECT<>")
        own_url = F.when(F.coalesce(empty, F.lit(False)), _get(obj, "url"))
        inner = F.when(
            shape.startswith("OBJECT"),
            F.coalesce(F.nullif(_get(image, "url"), F.lit("")), _get(image, "contentUrl")),
        )
        videos = [pick(kinds.contains("VideoObject"), "video", _get(obj, k)) for k in K.JSONLD_VIDEO_KEYS]
        main = pick(is_image | has_image, "image", F.coalesce(F.nullif(text, F.lit("")), own_url, inner))
        again = pick(has_image & ~is_image, "image", text)
        each = F.transform(
            listed,
            lambda x: pick(
                has_image & ~is_image,
                "image",
                F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(
                    _get(x, "url")
                ),
            ),
        )
        return F.when(
            F.schema_of_variant(obj).startswith("OBJECT"), F.concat(F.array(*videos, main, again), each)
        )

    parsed = F.try_parse_json(F.col("own_text"))
    objects = F.coalesce(F.try_variant_get(parsed, "$", _VARIANTS), F.array(parsed))
    found = F.filter(
        F.flatten(F.filter(F.transform(objects, read), lambda a: a.isNotNull())), lambda h: h.isNotNull()
    ).cast(f"array<{hit}>")
    return _on(
        (F.col("tag") == "script") & (_attr("type") == "application/ld+json") & parsed.isNotNull(),
        F.transform(
            found, lambda h, i: _candidate(STAGES["jsonld"], h["kind"], h["url"], "media_only", "json-ld", pos=i)
        ),
    )


def js_media() -> Column:
    """URLs that scripts mention in the usual source, loader and data-attribute forms."""
    def emitter(kind, group, base):
        return lambda u, i: _candidate(
            STAGES["script"], kind, u, "media", f"js-static-{group}", pos=i.cast("bigint") + base
        )

    named = [(group, p) for group, patterns in K.SCRIPT_MEDIA_PATTERNS.items() for p in patterns]
    groups = [
        F.transform(
            F.regexp_extract_all(F.col("own_text"), F.lit(pattern), 1),
            emitter("video" if "video" in group else "image", group, order * 1000000),
        )
        for order, (group, pattern) in enumerate(named)
    ]
    return _on((F.col("tag") == "script") & F.col("own_text").isNotNull(), F.concat(*groups))


def framework_media() -> Column:
    """Lazy sources of front-end frameworks that survive lower-cased attribute names."""
    value = _attr("v-lazy")
    return _on(
        value.rlike("^https?://"),
        F.array(_candidate(STAGES["data"], "auto", value, "media", "framework-vue", pos=-1)),
    )


def data_attr_media() -> Column:
    """``data-*`` values that are media URLs, or JSON objects holding them."""
    entries = F.filter(F.map_entries(F.col("attrs")), lambda e: e["key"].startswith("data-"))

    def read(e, i):
        value = F.trim(e["value"])
        base = i.cast("bigint") * 100000
        is_json = value.startswith("{") & value.endswith("}")
        parsed = F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>")
        strings = F.filter(F.map_entries(parsed), lambda p: F.schema_of_variant(p["value"]) == "STRING")
        from_json = F.transform(
            strings,
            lambda p, j: _candidate(
                STAGES["data"], "auto", F.try_variant_get(p["value"], "$", "string"), "media",
                F.concat(F.lit("data-json-"), e["key"], F.lit("-"), p["key"]), pos=base + j,
            ),
        )
        direct = F.array(
            _candidate(
                STAGES["data"], "auto", value, "media", F.concat(F.lit("data-direct-"), e["key"]), pos=base
            )
        )
        direct, from_json = direct.cast(_CANDIDATE), from_json.cast(_CANDIDATE)
        return F.when(value == "", _none()).when(is_json, F.coalesce(from_json, _none())).otherwise(direct)

    return F.coalesce(F.flatten(F.transform(entries, read)), _none())


def lazy_media() -> Column:
    options = [
        F.when(
            _filled(_attr(name)),
            _candidate(STAGES["lazy"] + n, "auto", _attr(name), "media", f"lazy-data-{name}"),
        )
        for n, name in enumerate(K.LAZY_ATTRIBUTES)
    ]
    return F.filter(F.array(*options), lambda c: c.isNotNull()).cast(_CANDIDATE)


@U.reusable
def extractors(
    rules: RuleBook | None = None, retry: bool = False, settings: Settings = DEFAULTS
) -> dict[str, Column]:
    """All extractors by name, in the order a page is read."""
    return {
        "picture": picture_images(rules, settings),
        "img": img_images(rules, retry, settings),
        "css": css_images(),
        "icon": icon_images(),
        "meta_image": meta_images(),
        "video": video_tags(),
        "embed": video_embeds(),
        "meta_video": meta_videos(),
        "jsonld": jsonld_media(None),
        "script": js_media(),
        "framework": framework_media(),
        "data": data_attr_media(),
        "lazy": lazy_media(),
    }


# --- from candidates to records ----------------------------------------------


_MEDIA_TAGS = ["img", "source", "video", "iframe", "meta", "link", "script"]


@U.reusable
def may_hold_media() -> Column:
    """Cheap test that spares most nodes the extractors: a media tag, or a style, data or lazy attribute."""
    named = F.map_keys("attrs")
    return F.col("tag").isin(_MEDIA_TAGS) | F.exists(named, lambda k: k.startswith("data-") | k.isin("style", "v-lazy"))


@U.reusable
def _resolved() -> Column:
    """URL of candidate ``c``, and whether its raw reference counts as media where that is asked."""
    test, ref = F.col("c.test"), F.col("c.ref")
    media_ok = F.when(test.isin("media", "media_only"), U.is_media_url(ref)).otherwise(F.lit(True))
    url = F.when(test == "media_only", ref).otherwise(U.url_join(F.col("page_url"), ref))
    return F.explode(F.array(F.struct(url.alias("url"), media_ok.alias("media_ok")))).alias("m")


@U.reusable
def _kept() -> Column:
    test, url = F.col("c.test"), F.col("m.url")
    absolute = test.isin("media_only", "media") | url.rlike("^https?://")
    passes = (
        F.when(test.isin("none", "media_only"), True)
        .when(test == "platform", U.video_platform(url).isNotNull())
        .when(test == "sized", U.is_significant(url, F.col("c.width")))
        .otherwise(U.is_significant(url))
    )
    return F.col("m.media_ok") & absolute & passes


@U.reusable
def _record() -> tuple:
    url, stage, cdn = F.col("m.url"), F.col("c.stage"), F.col("c.cdn")
    kind = F.when(F.col("c.kind") != "auto", F.col("c.kind")).when(url.rlike(r"\.mp4|\.webm"), "video").otherwise("image")
    is_cdn = F.when(cdn == "img", U.is_cdn_url(url, "img")).when(cdn == "video", U.is_cdn_url(url, "video"))
    embedded = stage.isin(STAGES["embed"], STAGES["meta_video"])
    return (
        F.col("page_id"),
        F.col("page_url"),
        stage,
        F.col("c.owner"),
        F.col("c.pos"),
        kind.alias("media_type"),
        url.alias("url"),
        F.col("c.source"),
        F.col("c.width"),
        F.col("c.height"),
        F.col("c.alt"),
        is_cdn.alias("is_cdn"),
        F.when(embedded, U.video_platform(url)).alias("platform"),
        F.col("c.transformed"),
        F.col("c.original_url"),
        F.col("c.attrs"),
    )


def extract(node_table: DataFrame, *candidates: Column) -> DataFrame:
    """Explode candidates once and keep those that pass their own test.

    Resolved URLs come out of a generator of their own, so the tests that
    follow read them instead of working them out again.
    """
    found = F.concat(*candidates) if len(candidates) > 1 else candidates[0]
    rows = node_table.filter(may_hold_media()).select("page_id", "page_url", F.explode(found).alias("c"))
    return rows.select("page_id", "page_url", "c", _resolved()).filter(_kept()).select(*_record())


def extract_media(
    node_table: DataFrame, rules: RuleBook | None = None, retry: bool = False, settings: Settings = DEFAULTS
) -> DataFrame:
    """Every media record of every page, one pass over the nodes."""
    return extract(node_table, *extractors(rules, retry, settings).values())
