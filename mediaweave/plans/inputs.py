"""Inputs the queries run on: the given tables and tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


_ID = "CAST(page_id AS STRING)"

# Markup added to each page, by page_id modulo 16; evaluated by both engines.
MARKUP = [
    """<img src="/pics/{i}.jpg" width="640" height="480" alt="view">""",
    """<img src="/s/{i}.jpg" srcset="/s/{i}-400.jpg 400w, /s/{i}-800.jpg 800w, /s/{i}-d.jpg 2x">""",
    """<img src="/t/{i}.jpg" data-full="/full/{i}.jpg">""",
    """<a href="/large/{i}.jpg"><img src="/t/{i}.jpg"></a>""",
    """<a href="/gallery/{i}"><img src="/t/{i}-300x200.jpg"></a><a href="/post/{i}"><img src="/t2/{i}.jpg"></a>""",
    """<div style="display:none"><img src="/h/{i}.jpg"></div><img class="d-none" src="/h2/{i}.jpg">""",
    """<picture><source srcset="/p/{i}.webp 900w" media="(min-width:800px)" type="image/webp">"""
    """<source srcset="/p/{i}.avif"><img src="/p/{i}.jpg"></picture>""",
    """<video src="/v/{i}.mp4" poster="/v/{i}.jpg"><source src="/v/{i}.webm" type="video/webm"></video>""",
    """<iframe src="https://player.vimeo.com/video/{i}"></iframe><iframe src="/frame/{i}"></iframe>""",
    """<script type="application/ld+json">{{"@type":"VideoObject","contentUrl":"https://m.example.net/v/{i}.mp4","""
    """"image":["https://m.example.net/i/{i}.jpg"]}}</script>""",
    """<div style="background-image:url(/bg/{i}.png)">x</div>""",
    """<meta property="og:image" content="/og/{i}.jpg"><link rel="icon" sizes="192x192" href="/fav/{i}.png">"""
    """<link rel="canonical" href="/c/{i}">""",
    """<script>var u="https://cdn.example.com/j/{i}.png";loadVideo("https://cdn.example.com/j/{i}.mp4");</script>""",
    """<div data-item="{{&quot;u&quot;:&quot;https://m.example.net/d/{i}.mp4&quot;}}" data-src="/lazy/{i}.jpg">x</div>""",
    """<img src="/x/{i}.gif"><img src="/uploads/{i}.jpg"><img src="/ok/{i}.jpg" alt="banner">""",
    """<script>window.location.href="/moved/{i}";</script><a class="enter" href="/in/{i}">I agree</a>""",
]


def _markup_case() -> str:
    arms = []
    for n, text in enumerate(MARKUP):
        pieces = [f"'{p}'" for p in text.replace("{{", "{").replace("}}", "}").split("{i}")]
        arms.append(f"WHEN {n} THEN " + f" || {_ID} || ".join(pieces))
    return "CASE page_id % 16 " + " ".join(arms) + " END"


def as_sql(columns: dict[str, str], source: str) -> str:
    """``SELECT`` text of a projection both engines understand."""
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {source}"


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


PAGES_MEDIA = {
    "page_id": "page_id",
    "url": "url",
    "html": f"replace(html, '</article>', {_markup_case()} || '</article>')",
}


def pages_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with media markup inserted at the end of its article."""
    return project(pages(spark, sf_dir), PAGES_MEDIA)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edges from every page to other pages: an equi join on computed page ids."""
    p = pages(spark, sf_dir).select("page_id", "url")
    n = p.agg(F.count("*")).scalar()
    ids = F.array((F.col("page_id") * 7 + 1) % n, (F.col("page_id") * 7 + 2) % n)
    targets = p.select("page_id", F.col("url").alias("src_url"), F.explode(F.array_distinct(ids)).alias("dst_id"))
    dst = p.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst_url"))
    return targets.join(dst, "dst_id").select("page_id", "src_url", "dst_url")


_EVENT = "CAST(event_id AS STRING)"
_HOST = "'h' || CAST(user_id % 40 AS STRING) || '.example.com'"

FETCH_LOG = {
    "event_id": "event_id",
    "ts": "ts",
    "host": _HOST,
    "url": f"""'https://' || {_HOST} || '/m/' || {_EVENT}
        || CASE event_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.mp4' WHEN 2 THEN '.gif'
                             WHEN 3 THEN '' ELSE '.html' END""",
    "media_type": "CASE WHEN event_id % 5 = 1 THEN 'video' ELSE 'image' END",
    "status": """CASE WHEN event_type = 'error'
        THEN CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 404 ELSE 503 END ELSE 200 END""",
    "content_type": """CASE WHEN event_id % 7 = 3 THEN 'text/html'
        WHEN event_id % 5 = 1 THEN 'video/mp4' ELSE 'image/jpeg' END""",
    "content_length": "CAST(floor(value * CASE WHEN event_id % 5 = 1 THEN 51200 ELSE 2048 END) AS BIGINT)",
}

JSON_PAYLOADS = {
    "doc_id": "event_id",
    "url": f"'https://api.example.com/api/list/' || {_EVENT}",
    "body": f"""'{{"items":[{{"id":' || {_EVENT} || ',"image":"/i/' || {_EVENT}
        || '.jpg"}},{{"meta":{{"video":"https://v.example.com/' || {_EVENT}
        || '.mp4"}}}},{{"photos":["/p/1.png","/p/2.gif"]}}],"props":' || props
        || ',"next":"/api/list/' || CAST(event_id + 1 AS STRING) || '"}}'""",
}


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch results, one per event."""
    return project(table(spark, sf_dir, "events"), FETCH_LOG)


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API body per event."""
    return project(table(spark, sf_dir, "events"), JSON_PAYLOADS)


def url_corpus(pages: DataFrame) -> DataFrame:
    """Distinct ``(page_id, base, url)``: every page URL, and every reference on its page made absolute."""
    refs = F.regexp_extract_all("html", F.lit(r"""(?:href|src|content|poster|data-full|data-src)="([^"]+)\""""), 1)
    found = F.concat(F.array_distinct(refs), F.array("url"))
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(found).alias("ref"))
    return rows.select("page_id", "base", F.explode(F.array(U.url_join("base", "ref"))).alias("url")).distinct()


# --- further tables derived from the given ones --------------------------------

_N = "CAST(page_id AS STRING)"

TASKS = {
    "id": f"'task-' || {_N}",
    "task_id": "page_id",
    "url": "url",
    "one_shot": "page_id % 5 = 0",
    "status": """CASE page_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused'
        WHEN 3 THEN 'completed' WHEN 4 THEN 'stopped' ELSE 'failed' END""",
    "download_path": f"'/downloads/t' || {_N}",
    "images": "page_id % 11",
    "videos": "page_id % 3",
    "downloaded": "page_id % 9",
}


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per page, with status, counters and times that follow from the page."""
    base = project(pages(spark, sf_dir), {**TASKS, "page_id": "page_id"})
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def after(seconds):
        return start + F.make_dt_interval(secs=seconds)

    seconds = F.col("page_id") * 61
    live = F.col("status") == "queued"
    ended = F.col("status").isin("completed", "stopped", "failed")
    return base.select(
        "id",
        "task_id",
        "url",
        "one_shot",
        "status",
        "download_path",
        F.create_map(
            F.lit("images_found"), F.col("images").cast("bigint"),
            F.lit("videos_found"), F.col("videos").cast("bigint"),
            F.lit("files_downloaded"), F.col("downloaded").cast("bigint"),
        ).alias("stats"),
        F.col("downloaded").cast("bigint").alias("files_downloaded"),
        after(seconds).alias("created_at"),
        F.when(~live, after(seconds + 30)).alias("started_at"),
        F.when(ended, after(seconds + 90)).alias("completed_at"),
    )


TASK_EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "task_id": "user_id",
    "action": """CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'signup' THEN 'complete'
        WHEN 'purchase' THEN 'stop' ELSE 'fail' END""",
}


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "events"), TASK_EVENTS)


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"

IMAGE_FORMS = [
    f"{_ORIGIN} || '/images/thumb/img' || {_N} || '_thumb.jpg'",
    f"{_ORIGIN} || '/t/' || {_N} || '.jpg'",
    f"'https://m.example.net/i/' || {_N} || '.jpg'",
    f"{_ORIGIN} || '/pics/' || {_N} || '-300x200.jpg'",
    f"{_ORIGIN} || '/a/' || {_N} || '-1024x768.png?x=1'",
    f"'https://cdn.artstation.com/p/' || {_N} || '_small.jpg'",
    f"'https://www.example.net/w/' || {_N} || '.jpg'",
]


def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnail-like image URLs seen on each page."""
    forms = ", ".join(IMAGE_FORMS)
    return pages(spark, sf_dir).selectExpr("page_id", "url AS page_url", f"explode(array({forms})) AS url")


SRCSET = (
    f"'/s/' || {_N} || '-a.jpg ' || CAST(page_id % 700 + 1 AS STRING) || 'w,  /s/' || {_N} || '-b.jpg '"
    f" || CAST(page_id % 3 AS STRING) || '.5x, /s/' || {_N} || '-c.jpg,, /s/' || {_N} || '-d.jpg 350w'"
)


def srcsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(pages(spark, sf_dir), {"page_id": "page_id", "srcset": SRCSET})


def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that redirect to the page with the next id, unless the next id is a multiple of 8."""
    p = pages(spark, sf_dir).select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    on = (F.col("page_id") + 1) % 8 != 0
    body = F.when(on & F.col("next_url").isNotNull(), F.concat(F.lit('<script>location="x";window.location = "'), "next_url", F.lit('";</script>')))
    return p.join(nxt, "page_id", "left").select("page_id", "url", F.coalesce(body, F.lit("<p>end</p>")).alias("html"))


_HOST_OF_URL = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts of the pages."""
    return pages(spark, sf_dir).selectExpr(f"{_HOST_OF_URL} AS host").distinct()


# configuration used by the rewriting queries: (link, img, to, res)
RULES = [
    (1, "thumb dir", "", r"^(.*)/thumb/(.+)_thumb[.](jpg)$", "$1/$2.$3", []),
    (2, "t to full", "", r"^(.*)/t/([0-9]+)[.]jpg$", "$1/full/$2.#jpg png#", []),
    (3, "cdn host", "", r"^m\.example\.net/i/(.+)$", "m.example.net/orig/$1", []),
    (4, "page capture", r"example[.]com/", "", "", [r'og:image" content="([^"]+)"']),
    (5, "any capture", r"example[.](?:org|net)/", "", "", [r'data-full="([^"]+)"', r'poster="([^"]+)"']),
    (6, "www host", r"^www\.example\.net/", r"^(https?://www[.]example[.]net)/w/(.+)$", "$1/big/$2", []),
    (7, "broken", "", r"^(unclosed", "$1", []),
    (8, "missing group", "", r"^x(.)y$", "$2", []),
    (9, "code", "", r"^(.+)[.]thumb$", ":return $[1]", []),
]
PATTERNS = [
    ("ex", ["example.org"], [], [("/pics/", "/pics-full/")]),
    ("art", [], [r"artstation\.com/p/"], [("_small", "")]),
    ("page", ["example.com"], [], [("-1024x768", "")]),
]
THUMBNAILS = [("/w/", "/whole/")]
BLOCKLIST = ["spam-farm.example.org", "www.cheap-pills.example.com"]


def rules_table(spark: SparkSession) -> DataFrame:
    from mediaweave.operators.rules import index_rules

    rows = [(i, i, n, link or None, img or None, to or None, res) for i, n, link, img, to, res in RULES]
    schema = "rule_id int, ord int, name string, link string, img string, to string, res array<string>"
    return index_rules(spark.createDataFrame(rows, schema))


def patterns_table(spark: SparkSession) -> DataFrame:
    rows = [(s, True, d, u, r) for s, d, u, r in PATTERNS]
    schema = (
        "site string, enabled boolean, domains array<string>, url_patterns array<string>, "
        "replacements array<struct<source:string,target:string>>"
    )
    return spark.createDataFrame(rows, schema)


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in BLOCKLIST], "host string")


REFS = [
    "", "x.jpg", "../a/./b", "?q=1", "#f", "//cdn.example.com/p", "/r", "/r/../s/", "./..", "../../../../g",
    "https://z.example.com/y", "mailto:x", "a/b.jpg?c=d#e", "g/../../h",
]

POSTS = {
    "post_id": "page_id",
    "body": f"""'{{"urls":[{{"url":" ' || url || '","source":"' || url || '","type":"video"}},{{"url":"//cdn.example.com/p/'
        || {_N} || '.jpg?x=1"}},{{"url":"ftp://x/y"}},{{"url":"https://h.example.com/d/' || {_N} || '/"}}],"one_shot":'
        || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}'""",
}

SETTING_KEYS = ["search_depth", "timeout", "page_limit", "user_agent", "note"]
_VALUE = "CAST(event_id % 1000 - 20 AS STRING)"
SETTINGS = {
    "event_id": "event_id",
    "search_depth": _VALUE,
    "timeout": f"CASE WHEN event_id % 3 = 0 THEN event_type ELSE {_VALUE} END",
    "page_limit": f"CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '1.5' ELSE {_VALUE} END",
    "user_agent": "event_type || chr(13) || chr(10) || 'x'",
    "note": "event_type || chr(10)",
}

IMAGE_ATTRS = {
    "width": "CASE page_id % 9 WHEN 0 THEN '1' WHEN 1 THEN '728' WHEN 2 THEN '120' WHEN 3 THEN '' WHEN 4 THEN '50%'"
    " WHEN 5 THEN '99' WHEN 6 THEN NULL ELSE '640' END",
    "height": "CASE page_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '90' WHEN 2 THEN '600' WHEN 3 THEN NULL ELSE '480' END",
    "css": "CASE page_id % 11 WHEN 0 THEN 'Top Banner' WHEN 1 THEN 'hero' END",
    "dom_id": "CASE page_id % 13 WHEN 0 THEN 'promo-1' WHEN 1 THEN 'main' END",
    "alt": "CASE page_id % 5 WHEN 0 THEN 'Sponsored' WHEN 1 THEN '' WHEN 2 THEN 'view' END",
}
