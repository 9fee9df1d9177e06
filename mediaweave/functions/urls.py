"""URL functions as Column builders.

Every function takes a Column (or column name) and returns a Column made of
JVM-side expressions, so it runs inside the scan stage that feeds it and needs
no Python worker.  ``parse_url`` is not used: it returns NULL for paths holding
a space, ``|`` or a non-ASCII letter, which are common in crawled links.
"""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaweave import constants as K

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#((?s:.*)))?"
_TO_PATH = r"^(?:[^:/?#]++:)?+(?://[^/?#]*+)?+"
_HAS_DOTS = r"(?:^|/)\.\.?(?:/|$)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reusable(fn):
    """Build an expression over column names once per session.

    Expressions are made call by call through the JVM gateway, which takes
    longer than running them on a small table.  Calls that are handed Columns
    are built every time.
    """
    built: dict = {}

    @functools.wraps(fn)
    def call(*args, **named):
        if any(isinstance(a, Column) for a in (*args, *named.values())):
            return fn(*args, **named)
        key = (id(SparkContext._gateway), repr(args), repr(sorted(named.items())))
        if key not in built:
            built[key] = fn(*args, **named)
        return built[key]

    return call


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(words) -> str:
    """Regex alternation matching any of the words literally."""
    return "(?:" + "|".join(re.escape(w).replace(r"\-", "-").replace("/", "/") for w in words) + ")"


def any_pattern(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def path_ends(lowered: Column, extensions) -> Column:
    """The path of a lower-cased URL ends with one of the extensions.

    A ``;params`` tail of the last segment does not belong to the path.
    """
    return lowered.rlike(_TO_PATH + r"(?:[^?#]*/)?[^/?#;]*" + any_of(extensions) + r"(?:;[^/?#]*)?(?:[?#]|\z)")


def _ends(lowered: Column, extensions) -> Column:
    return lowered.rlike(any_of(extensions) + r"\z")


def _has(text: Column, words) -> Column:
    return text.rlike(any_of(words))


# --- parts ------------------------------------------------------------------


def scheme(c) -> Column:
    return F.lower(F.regexp_extract(col(c), _SPLIT, 1))


def get_domain(c) -> Column:
    """Network location with its port; empty when there is none."""
    return F.regexp_extract(col(c), _SPLIT, 2)


def path(c) -> Column:
    """Path without the ``;params`` tail of its last segment."""
    return F.regexp_replace(F.regexp_extract(col(c), _SPLIT, 3), r";[^/]*$", "")


def query(c) -> Column:
    return F.regexp_extract(col(c), _SPLIT, 4)


def fragment(c) -> Column:
    return F.regexp_extract(col(c), _SPLIT, 5)


def url_parts(c) -> Column:
    return F.struct(
        scheme(c).alias("scheme"),
        get_domain(c).alias("netloc"),
        path(c).alias("path"),
        query(c).alias("query"),
        fragment(c).alias("fragment"),
    )


def is_absolute(c) -> Column:
    return col(c).rlike("^https?://")


def is_valid_url(c) -> Column:
    return F.coalesce(col(c).rlike(r"^(?i:https?)://[^/?#]"), F.lit(False))


@reusable
def normalize_url(c) -> Column:
    """Lower scheme and host, drop the fragment and one trailing slash, keep the query."""
    c = col(c)
    base = F.regexp_replace(c, r"(?s)#.*$", "")
    head = F.regexp_extract(base, r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1)
    raw_path = F.regexp_extract(base, _SPLIT, 3)
    short = F.regexp_replace(raw_path, r"^(.+)/(;[^/]*)?$", "$1$2")
    q = F.regexp_extract(base, _SPLIT, 4)
    return F.coalesce(
        F.concat(F.lower(head), short, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))),
        F.lit(""),
    )


def base_of_host(host) -> Column:
    """Last two labels of a host."""
    return F.substring_index(col(host), ".", -2)


def base_domain(c) -> Column:
    return base_of_host(get_domain(c))


@reusable
def is_same_domain(a, b) -> Column:
    da, db = get_domain(a), get_domain(b)
    return (da != "") & (db != "") & (base_of_host(da) == base_of_host(db))


def _collapse_dots(parts: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of path segments."""
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return F.array_join(F.concat(kept, tail), "/")


def _rooted(p: Column) -> Column:
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


@reusable
def url_join(base, ref) -> Column:
    """Absolute form of ``ref`` seen on page ``base``."""
    base, ref = col(base), col(ref)

    def resolve(pair):
        b, r = pair["b"], pair["r"]
        origin = F.regexp_extract(b, r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1)
        b_path = F.regexp_extract(b, _SPLIT, 3)
        r_path = F.regexp_extract(r, r"^([^?#]*)", 1)
        r_tail = F.regexp_extract(r, r"^[^?#]*((?s:.*))$", 1)
        folder = F.regexp_replace(F.regexp_extract(b_path, r"^(.*/)?", 1), "/{2,}", "/")
        inner = F.regexp_replace(r_path, "/{2,}", "/")
        merged = F.when(r_path.startswith("/"), r_path).otherwise(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), inner)
        )
        resolved = F.when(
            merged.rlike(_HAS_DOTS), _rooted(_collapse_dots(F.split(merged, "/", -1)))
        ).otherwise(merged)
        # the two forms nearly all links have come first and need no dot handling
        return (
            F.when(r.rlike("^https?:"), r)
            .when(
                r.rlike(r"^(?![^?#]*/\.\.?(?:[/?#]|$))/(?!/)"),
                F.concat(F.regexp_extract(b, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?", 0), r),
            )
            .when(r == "", b)
            .when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), r)
            .when(r.startswith("//"), F.concat(F.regexp_extract(b, r"^([^:/?#]+:)?", 1), r))
            .when(r.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), r))
            .when(r.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), r))
            .otherwise(F.concat(origin, resolved, r_tail))
        )

    clean = F.regexp_replace(F.translate(ref, "\t\r\n", ""), r"^[\x00-\x20]+|^//(?=/)", "")
    return let(F.struct(base.alias("b"), clean.alias("r")), resolve)


@reusable
def path_segments(c) -> Column:
    return F.filter(F.split(F.lower(path(c)), "/"), lambda x: x != "")


def file_basename(c) -> Column:
    return F.substring_index(F.substring_index(col(c), "?", 1), "/", -1)


# --- classification ---------------------------------------------------------

_SITE = r"^https?://[a-zA-Z0-9\-.]+\.[a-zA-Z]{2,3}/\S*\."
_IMAGE_FILE = _SITE + r"(?:jpg|jpeg|gif|png|webp|avif)"
_IMAGE_MEDIA = _SITE + r"(?:jpg|jpeg|gif|png|webp|avif|svg|tiff)"
_VIDEO_FILE = _SITE + r"(?:mp4|webm|ogg|mov|avi|wmv|flv|mkv|m4v|ts|m3u8)"
_STREAM_FILE = r"^https?://\S+(?:\.(?:m3u8|mpd)|/playlist\.m3u8|/manifest\.mpd)"


@reusable
def is_image_url(c) -> Column:
    low = F.lower(col(c))
    return path_ends(low, K.IMAGE_EXTENSIONS) | low.rlike(_IMAGE_FILE)


@reusable
def is_trash_media(c) -> Column:
    return F.coalesce(path_ends(F.lower(col(c)), K.TRASH_EXTENSIONS), F.lit(False))


def _is_media(low: Column) -> Column:
    files = K.IMAGE_EXTENSIONS + K.VIDEO_EXTENSIONS + K.AUDIO_EXTENSIONS
    loose = files + K.STREAM_EXTENSIONS + K.DOCUMENT_EXTENSIONS
    return (
        F.when(path_ends(low, files), True)
        .when(_has(low, K.FULLSIZE_WORDS) & _has(low, files), True)
        .when(_ends(low, K.WEBPAGE_EXTENSIONS + K.SCRIPT_EXTENSIONS), False)
        .when(low.rlike("|".join([_IMAGE_MEDIA, _VIDEO_FILE, _STREAM_FILE])), True)
        .when(_has(low, K.VIDEO_PLATFORM_INDICATORS), True)
        .when(low.rlike(any_of(loose) + r"(?:\z|[?&])"), True)
        .when(_has(get_domain(low), K.CDN_MEDIA_HOSTS), True)
        .when(_has(path(low), K.MEDIA_PATHS), True)
        .otherwise(query(low).rlike(any_of(K.MEDIA_PARAMS) + "(?:_id)?="))
    )


@reusable
def is_media_url(c) -> Column:
    return let(F.lower(col(c)), _is_media)


@reusable
def is_video_url(c) -> Column:
    def test(low):
        return (
            path_ends(low, K.VIDEO_URL_EXTENSIONS)
            | _has(get_domain(low), K.VIDEO_HOSTS)
            | _has(path(low), K.VIDEO_PATHS)
            | query(low).rlike(any_of(K.VIDEO_PARAMS) + "=")
            | low.rlike(any_pattern(K.VIDEO_NAME_PATTERNS))
            | low.rlike("|".join([_VIDEO_FILE, _STREAM_FILE]))
        )

    return let(F.lower(col(c)), test)


@reusable
def is_webpage_url(c) -> Column:
    def test(low):
        return (
            F.when(_is_media(low), False)
            .when(_ends(low, K.NOT_A_PAGE_EXTENSIONS), False)
            .when(_has(low, K.FULLSIZE_PAGE_WORDS) & _has(low, K.NOT_A_PAGE_EXTENSIONS), False)
            .when(_ends(low, K.WEBPAGE_EXTENSIONS), True)
            .when(low.rlike(any_pattern(K.CMS_PATTERNS)), True)
            .when(query(low) != "", ~path_ends(low, K.NOT_A_PAGE_EXTENSIONS))
            .otherwise(False)
        )

    return let(F.lower(col(c)), test)


def skip_words(extra=None) -> list[str]:
    """Skip segments plus the stop words of three or more characters."""
    words = [(w or "").strip().lower().strip("/") for w in (extra or [])]
    return K.SKIP_SEGMENTS + [w for w in words if len(w) >= 3]


@reusable
def should_skip_crawl_url(c, extra=None) -> Column:
    def test(low):
        segments = F.split(path(low), "/")
        return (
            (low == "")
            | path_ends(low, K.SKIP_CRAWL_EXTENSIONS)
            | F.arrays_overlap(segments, F.array(*[F.lit(w) for w in skip_words(extra)]))
            | _has(low, K.AD_HOSTS)
        )

    return F.coalesce(let(F.lower(col(c)), test), F.lit(True))


@reusable
def is_cdn_url(c, kind: str = "img") -> Column:
    return col(c).rlike("(?i)" + any_pattern(K.CDN_PATTERNS[kind]))


@reusable
def video_platform(c) -> Column:
    def test(low):
        host = get_domain(low)
        out = F.when(_has(path(low), K.DIRECT_VIDEO_EXTENSIONS), F.lit("direct-video"))
        for name, patterns in K.VIDEO_PLATFORMS.items():
            out = out.when(host.rlike(any_pattern(patterns)), F.lit(name))
        return out

    return let(F.lower(col(c)), test)


@reusable
def guess_media_type(c) -> Column:
    def test(low):
        return (
            F.when(path_ends(low, K.IMAGE_EXTENSIONS), "image")
            .when(path_ends(low, K.VIDEO_EXTENSIONS), "video")
            .when(path_ends(low, K.AUDIO_EXTENSIONS), "audio")
            .when(_has(low, K.VIDEO_PLATFORM_INDICATORS), "video")
            .otherwise("file")
        )

    return let(F.lower(col(c)), test)


def is_json_endpoint(c) -> Column:
    low = F.lower(col(c))
    return path(low).rlike(r"/api/|/json/|\.json$") | query(low).rlike("format=json|output=json|callback=")


@reusable
def looks_like_url(c) -> Column:
    return F.coalesce(
        col(c).rlike(r"^https?://|^/|\./|(?U)^[\w\-.]+\.[a-zA-Z]{2,}(?:/[\w\-./?&=#%]*)?$"), F.lit(False)
    )


def is_media_key(c) -> Column:
    return _has(F.lower(col(c)), K.MEDIA_KEY_WORDS)


def as_int(c) -> Column:
    """Whole number in a text, else NULL (a decimal is not a whole number)."""
    c = col(c)
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("bigint"))


def is_banner_or_ad(url, width=None, height=None, css_class=None, dom_id=None, alt=None) -> Column:
    """Ad wording in the URL or attributes, a tracking-pixel size, or a banner shape."""
    none = F.lit(None).cast("string")
    width, height = (none if x is None else col(x) for x in (width, height))
    w, h = as_int(width), as_int(height)
    shape = (
        ((w <= 5) & (h <= 5)) | (w >= 3 * h) | ((h >= 5 * w) & (w < 300))
    )
    texts = [url] + [x for x in (css_class, dom_id, alt) if x is not None]
    wording = [F.coalesce(_has(F.lower(col(t)), K.AD_WORDS), F.lit(False)) for t in texts]
    out = F.coalesce(shape, F.lit(False))
    for test in wording:
        out = out | test
    return out


@reusable
def is_significant(url, width=None, height=None, css_class=None, dom_id=None, alt=None) -> Column:
    """Worth keeping: not trash, ad, noise, nor declared under 100 px."""
    none = F.lit(None).cast("string")
    width, height = (none if x is None else col(x) for x in (width, height))
    w, h = as_int(F.coalesce(width, F.lit("1000"))), as_int(F.coalesce(height, F.lit("1000")))
    side = K.MIN_SIGNIFICANT_SIDE
    return (
        ~is_trash_media(url)
        & ~is_banner_or_ad(url, width, height, css_class, dom_id, alt)
        & ~_has(F.lower(col(url)), K.NOISE_WORDS)
        & ~F.coalesce(w.isNotNull() & h.isNotNull() & ((w < side) | (h < side)), F.lit(False))
    )


def is_not_noise(url) -> Column:
    return ~is_trash_media(url) & ~_has(F.lower(col(url)), K.NOISE_WORDS)


@reusable
def is_junk_url(c) -> Column:
    return col(c).rlike("(?i)" + any_pattern(K.BROWSER_JUNK_PATTERNS))


# --- crawl relevance --------------------------------------------------------


@reusable
def is_likely_content(c) -> Column:
    def test(low):
        words = any_of(K.CONTENT_WORDS)
        p = path(low)
        return (
            p.rlike(words + r"|/\d+|/(?:0[1-9]|1[0-2])/(?:[0-2][0-9]|3[01])/(?:19|20)\d{2}")
            | query(low).rlike(words)
            | fragment(low).rlike(words)
        )

    return let(F.lower(col(c)), test)


@reusable
def is_homepage(c) -> Column:
    def test(v):
        labels = F.split(v["h"], "\\.")
        bare = (F.size(labels) <= 3) & ((labels[0] == "www") | (F.size(labels) == 2))
        return F.lower(v["p"]).isin(K.HOME_PATHS) | (v["p"].isin("", "/") & (bare | (v["q"] != "")))

    return let(F.struct(path(c).alias("p"), get_domain(c).alias("h"), query(c).alias("q")), test)


@reusable
def nav_count(c) -> Column:
    """How many of the navigation words occur in the path or query."""
    low = F.lower(col(c))
    words = F.array(*[F.lit(w) for w in K.NAV_WORDS])

    def count(v):
        return F.size(F.filter(words, lambda w: F.contains(v["p"], w) | F.contains(v["q"], w)))

    return let(F.struct(path(low).alias("p"), query(low).alias("q")), count)


@reusable
def common_prefix_len(a, b) -> Column:
    """Number of equal leading path segments of two URLs."""
    pairs = F.arrays_zip(path_segments(a).alias("x"), path_segments(b).alias("y"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("same"))

    def step(acc, pair):
        same = acc["same"] & F.coalesce(pair["x"] == pair["y"], F.lit(False))
        return F.struct((acc["n"] + same.cast("int")).alias("n"), same.alias("same"))

    return F.aggregate(pairs, start, step, lambda acc: acc["n"])


def trimmed_path(c) -> Column:
    return F.regexp_replace(F.lower(path(c)), "^/+|/+$", "")


def has_id(trimmed: Column) -> Column:
    return trimmed.rlike(r"/\d+(?:/|$)")


def id_prefix(trimmed: Column) -> Column:
    """What stands before the first number that is a path segment."""
    return F.regexp_extract(trimmed, r"^(.*?)/\d+(?:/|$)", 1)


def in_section(trimmed: Column) -> Column:
    return trimmed.rlike(any_of(K.CONTENT_SECTIONS))


@reusable
def is_related(url, start, stay_in_domain: bool = True, retry=None) -> Column:
    """Downward test: the URL belongs to the section the crawl started from."""
    url, start = col(url), col(start)
    if not stay_in_domain:
        return F.lit(True)

    def test(v):
        uh, sh, up, sp = v["uh"], v["sh"], v["up"], v["sp"]
        us, ss = F.filter(F.split(up, "/"), lambda x: x != ""), F.filter(F.split(sp, "/"), lambda x: x != "")
        ids = has_id(up) & has_id(sp)
        return (
            F.when((uh != sh) & sh.endswith(F.concat(F.lit("."), uh)), False)
            .when((uh != sh) & (base_of_host(uh) != base_of_host(sh)), False)
            .when(sp == "", F.length(up) > 0)
            .when((up == sp) | up.startswith(F.concat(sp, F.lit("/"))), True)
            .when((F.size(us) > 0) & (F.get(us, 0) == F.get(ss, 0)), True)
            .when(ids & (id_prefix(up) == id_prefix(sp)), True)
            .when(in_section(up) & in_section(sp), True)
            .otherwise((F.size(ss) <= 1) & (F.size(us) <= 2))
        )

    parts = F.struct(
        F.lower(get_domain(url)).alias("uh"),
        F.lower(get_domain(start)).alias("sh"),
        trimmed_path(url).alias("up"),
        trimmed_path(start).alias("sp"),
    )
    out = F.when(start.isNull() | (start == ""), True).otherwise(let(parts, test))
    return out if retry is None else (F.coalesce(col(retry), F.lit(False)) | out)


# --- names and headers ------------------------------------------------------


def sanitize_filename(c) -> Column:
    """File name safe on common file systems; empty names become a hash."""
    raw = col(c)
    s = F.regexp_replace(raw, r'[<>:"/\\|?*\x00-\x1f]+', "_")
    s = F.regexp_replace(s, r"(?U)\s+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "__+", "_"), "^_+|_+$", "")

    def build(v):
        split = r"(?s)^(\.*[^.].*)(\.[^.]*)$"
        has_ext = v["s"].rlike(split)
        name = F.when(has_ext, F.regexp_extract(v["s"], split, 1)).otherwise(v["s"])
        ext = F.when(has_ext, F.regexp_extract(v["s"], split, 2)).otherwise(F.lit(""))
        ext = F.substring(ext, 1, K.MAX_EXTENSION_LENGTH)
        hashed = F.substring(F.md5(v["raw"].cast("binary")), 1, K.NAME_HASH_LENGTH)
        return F.when(
            name == "", F.concat(hashed, F.when(ext == "", F.lit(".jpg")).otherwise(ext))
        ).otherwise(F.concat(F.substring(name, 1, K.MAX_NAME_LENGTH), ext))

    return let(F.struct(s.alias("s"), raw.alias("raw")), build)


@reusable
def filename_from_url(url, media_type) -> Column:
    url = col(url)
    name = F.substring_index(F.regexp_replace(path(url), "^/+|/+$", ""), "/", -1)
    default = F.when(col(media_type) == "image", F.lit(".jpg")).otherwise(F.lit(".mp4"))
    hashed = F.substring(F.md5(url.cast("binary")), 1, K.NAME_HASH_LENGTH)
    return sanitize_filename(
        F.when(name.contains("."), name)
        .when(name != "", F.concat(name, default))
        .otherwise(F.concat(hashed, default))
    )


@reusable
def target_dir(page_url) -> Column:
    """Folder of a page's media: host, then its first two path parts."""
    bad = r'[<>:"/\\|?*]'
    host = F.regexp_replace(get_domain(page_url), bad, "_")
    parts = F.slice(F.filter(F.split(path(page_url), "/"), lambda x: x != ""), 1, K.MAX_DIR_PARTS)
    safe = F.transform(parts, lambda x: F.substring(F.regexp_replace(x, bad, "_"), 1, K.MAX_DIR_PART_LENGTH))
    return F.when(host == "", F.lit("")).otherwise(F.array_join(F.concat(F.array(host), safe), "/"))


def task_folder(url, ts) -> Column:
    pieces = F.split(col(url), "/")
    host = F.when(F.size(pieces) > 2, F.replace(F.get(pieces, 2), F.lit("."), F.lit("_"))).otherwise(F.lit("unknown"))
    return F.concat(host, F.lit("_"), F.date_format(col(ts), "yyyyMMdd_HHmmss"))


def referer_for(policy, source) -> Column:
    policy, source = col(policy), col(source)
    origin = F.concat(scheme(source), F.lit("://"), get_domain(source))
    return F.when(source.isNull() | (source == ""), F.lit(None)).when(policy == "origin", origin).when(
        policy == "auto", source
    )
