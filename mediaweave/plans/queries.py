"""Registry of queries: one per operator, over the given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave import constants as K
from mediaweave.functions import rewrite as Rw
from mediaweave.functions import urls as U
from mediaweave.operators import frontier as Fr
from mediaweave.operators import health as H
from mediaweave.operators import jsonmedia as J
from mediaweave.operators import links as L
from mediaweave.operators import manifest as Mf
from mediaweave.operators import media as M
from mediaweave.operators import rules as R
from mediaweave.operators import scan as S
from mediaweave.operators import tasks as Tk
from mediaweave.operators.nodes import is_visible, nodes, with_relative
from mediaweave.operators.ordered import global_rank
from mediaweave.operators.ruleindex import RuleIndex
from mediaweave.plans import inputs as I
from mediaweave.plans.crawl import best_first_crawl, crawl, visit_rank
from mediaweave.session import checkpoint_folder, settled
from mediaweave.sources import files as Fs
from mediaweave.sources import pages as P
from mediaweave.streaming import streams as St

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """New folder for a query that writes and reads back, beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/mediaweave/{name}-{uuid.uuid4().hex}"


# --- shared inputs -------------------------------------------------------------


def media_pages(spark, sf) -> DataFrame:
    return I.project(P.spread(I.pages(spark, sf)), I.PAGES_MEDIA)


def page_nodes(spark, sf) -> DataFrame:
    """The nodes that media and link operators read."""
    return nodes(media_pages(spark, sf), marked_only=True)


def stored_nodes(spark, sf) -> DataFrame:
    """The same nodes written out once, for plans that read them several times."""
    return settled(page_nodes(spark, sf))


def all_nodes(spark, sf) -> DataFrame:
    return nodes(media_pages(spark, sf))


def book(spark) -> Rw.RuleBook:
    return R.rule_book(I.rules_table(spark), I.patterns_table(spark), I.THUMBNAILS)


def page_media(spark, sf) -> DataFrame:
    return M.extract_media(page_nodes(spark, sf))


def fetches(spark, sf) -> DataFrame:
    return P.spread(I.fetch_log(spark, sf), key="event_id")


def joined(c, sep="|"):
    return F.array_join(c, sep)


# --- the first end-to-end query ------------------------------------------------


@query("q00_top_link_hosts")
def top_link_hosts(spark, sf):
    """Top hosts by distinct outgoing links."""
    refs = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]+)"'), 1)
    found = I.pages(spark, sf).select("url", F.explode(refs).alias("ref"))
    links = found.select(U.normalize_url(U.url_join("url", "ref")).alias("link")).distinct()
    return (
        links.groupBy(U.get_domain("link").alias("host"))
        .agg(F.count("*").alias("n_links"))
        .orderBy(F.desc("n_links"), "host")
        .limit(10)
    )


# --- sources and sinks -----------------------------------------------------------


@query("s01_read_pages")
def _(spark, sf):
    pages = P.with_status(P.read_pages(spark, f"{sf}/pages.parquet"))
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), "error_status")


@query("s02_decode_bytes")
def _(spark, sf):
    raw = I.pages(spark, sf).select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.col("html").cast("binary"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.col("html").cast("binary")))
        .otherwise(F.encode("html", "UTF-16"))
        .alias("content"),
    )
    decoded = raw.select("page_id", P.charset_of(F.col("content")).alias("charset"), P.decode_bytes(F.col("content")).alias("t"))
    return decoded.select("page_id", "charset", F.md5(F.col("t").cast("binary")).alias("digest"))


def _payloads(spark, sf) -> DataFrame:
    return J.read_payloads(P.spread(I.json_payloads(spark, sf), key="doc_id", rows=J.ROWS))


@query("s03_read_json_payloads")
def _(spark, sf):
    cut = F.when(F.col("doc_id") % 4 == 1, F.expr("substr(body, 1, length(body) - 1)")).when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit("x"), F.col("body"))
    )
    broken = I.json_payloads(spark, sf).withColumn("body", F.coalesce(cut, "body"))
    parsed = J.read_payloads(broken)
    return parsed.select(
        "doc_id",
        F.col("payload").isNotNull().alias("parsed"),
        F.try_variant_get("payload", "$.next", "string").alias("next"),
    )


@query("s04_read_blocklist")
def _(spark, sf):
    hosts = I.page_hosts(spark, sf)
    form = F.when(F.length("host") % 3 == 0, F.concat(F.lit("# "), "host")).when(
        F.length("host") % 3 == 1, F.concat(F.lit("  "), "host", F.lit(" "))
    )
    path = scratch(spark, "blocklist")
    hosts.select(F.coalesce(form, "host").alias("value")).write.text(path)
    return P.read_blocklist(spark, path)


def _pattern_files(spark, sf) -> DataFrame:
    """Two pattern files per host: a list layout, then a keyed layout for longer hosts."""
    hosts = I.page_hosts(spark, sf)
    off = F.when(F.length("host") % 4 == 0, "false").otherwise("true")
    listed = F.concat(
        F.lit('{"patterns":[{"site":"'), "host", F.lit('","enabled":'), off, F.lit(',"domains":["'), "host",
        F.lit('"],"image_transformations":{"replace_patterns":[{"source":"/t/","target":"/f/"}]}}]}'),
    )
    keyed = F.concat(
        F.lit('{"'), "host", F.lit('":{"url_patterns":["/en/"],"imagus_patterns":{"media":[{"source":"/s/","target":"/l/"}]}}}')
    )
    first = hosts.select(F.lit(0).alias("file"), listed.alias("value"))
    return first.unionByName(
        hosts.filter(F.length("host") > 20).select(F.lit(1).alias("file"), keyed.alias("value"))
    )


@query("s05_read_site_patterns")
def _(spark, sf):
    """Pattern files are written and read again; those of the second folder take precedence."""
    path = scratch(spark, "patterns")
    files = _pattern_files(spark, sf).withColumn("name", F.md5(F.col("value").cast("binary")))
    files.write.partitionBy("file", "name").text(path)
    p = P.read_site_patterns(spark, [f"{path}/file=0", f"{path}/file=1"])
    return p.select(
        "site", "enabled", joined(F.coalesce("domains", F.array().cast("array<string>"))).alias("domains"),
        joined(F.coalesce("url_patterns", F.array().cast("array<string>"))).alias("url_patterns"),
        joined(F.transform("replacements", lambda r: F.concat(r["source"], F.lit(">"), r["target"]))).alias("replacements"),
    )


def _rule_files(spark, sf) -> DataFrame:
    """A rule file per host: an entry that is no object, a host rule and a global rule."""
    host = F.replace(F.col("host"), F.lit("."), F.lit("\\\\."))
    return I.page_hosts(spark, sf).select(
        F.concat(
            F.lit('{"note":5,"'), "host", F.lit('":{"link":"^(www\\\\.)?'), host,
            F.lit('/(.+)","img":"^(.+)/t/(.+)","to":"$1/f/$2","res":["src=(a)","src=(b)"]},"g":{"img":"thumb-(.+)","to":"$1"'),
            F.when(F.length("host") % 2 == 0, ',"link":"x","res":"c(d)"').otherwise(""),
            F.lit("}}"),
        ).alias("value")
    )


@query("s06_read_rules")
def _(spark, sf):
    path = scratch(spark, "rules")
    files = _rule_files(spark, sf)
    files.withColumn("file", F.md5(F.col("value").cast("binary"))).write.partitionBy("file").text(path)
    rules = P.read_rules(spark, path)
    return rules.select("ord", "name", "link", "img", "to", joined("res").alias("res"), "domain")


@query("s07_rule_domain")
def _(spark, sf):
    hosts = I.page_hosts(spark, sf)
    escaped = F.replace(F.col("host"), F.lit("."), F.lit("\\."))
    forms = F.array(
        F.concat(F.lit("^("), escaped, F.lit("/x)")),
        F.concat(F.lit("^www\\."), F.upper(escaped), F.lit("/")),
        F.concat(F.lit("/img/"), F.col("host")),
        escaped,
    )
    rows = hosts.select("host", F.posexplode(forms).alias("form", "regex"))
    return rows.select("host", "form", R.rule_domain("regex").alias("domain"))


@query("s08_res_patterns")
def _(spark, sf):
    rules = R.res_patterns(P.parse_rules(_rule_files(spark, sf)))
    return rules.select("name", "link", joined("res").alias("res"))


@query("s09_export_tasks_csv")
def _(spark, sf):
    tasks, path = I.tasks(spark, sf), scratch(spark, "tasks-csv")
    Fs.export_tasks_csv(tasks, path)
    rows, kinds = Fs.read_tasks_csv(spark, path), dict(Tk.export_rows(tasks).dtypes)
    # an empty field is an empty text
    read = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")).cast(kinds[c]) for c in rows.columns}
    return rows.select([v.alias(c.lower() if c != "#" else "position") for c, v in read.items()])


def _imported(spark, sf) -> DataFrame:
    t = I.tasks(spark, sf)
    rows = t.select(
        F.when(F.col("task_id") % 7 == 3, "  ").otherwise(F.concat(F.lit(" "), "url")).alias("URL"),
        F.col("download_path").alias("Path"),
        "status",
    )
    outputs = t.select(F.col("download_path").alias("path"), (F.col("task_id") % 4 - 1).alias("n_files"))
    path = scratch(spark, "import-csv")
    rows.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    rows = Fs.read_tasks_csv(spark, path)
    return Tk.import_rows(rows, outputs, F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))


@query("s10_import_tasks_csv")
def _(spark, sf):
    return _imported(spark, sf)


@query("s11_tasks_json_round_trip")
def _(spark, sf):
    path = scratch(spark, "tasks")
    t = I.tasks(spark, sf)
    stamps = {c: F.col(c).cast("timestamp") for c in ("created_at", "started_at", "completed_at")}
    Fs.write_tasks_json(t.withColumns(stamps).drop("task_id", "files_downloaded"), path)
    back = Fs.read_tasks_json(spark, path)
    return back.select(
        "id", "url", "one_shot", "status", F.col("stats")["images_found"].alias("images_found"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def _posts(spark, sf) -> DataFrame:
    return I.project(I.pages(spark, sf), I.POSTS)


@query("s12_posted_items")
def _(spark, sf):
    return Tk.posted_items(_posts(spark, sf))


@query("s13_state_round_trip")
def _(spark, sf):
    folder = scratch(spark, "state")
    p = I.pages(spark, sf)
    frontier = p.select("url", F.lit(1).alias("depth"), (F.col("page_id") / 8).cast("double").alias("priority"))
    visited = p.select(U.normalize_url("url").alias("norm_url")).distinct()
    Fs.save_state({"frontier": frontier, "visited": visited}, folder, 3)
    back = Fs.load_state(spark, folder, 3)
    return back["frontier"].join(back["visited"], U.normalize_url("url") == F.col("norm_url"))


@query("s13_snapshot")
def _(spark, sf):
    """All five tables under a version; a later version that was never finished is passed over."""
    folder = scratch(spark, "snapshots")
    p = I.pages(spark, sf)
    log = I.fetch_log(spark, sf).select("event_id", "ts", "host")
    health = settled(_health(spark, sf))
    tables = {
        "frontier": p.select("url", F.lit(1).alias("depth"), (F.col("page_id") / 8).cast("double").alias("priority")),
        "manifest": I.image_urls(spark, sf).select("url").distinct(),
        "quarantine": H.set_aside(log, H.quarantined(health)),
        "visited": p.select(U.normalize_url("url").alias("norm_url")).distinct(),
        "health": health,
    }
    Fs.save_snapshot(tables, folder, 1)
    Fs.write_tables({"frontier": tables["visited"]}, f"{folder}/version=2")
    version, back = Fs.load_snapshot(spark, folder)
    keys = {"frontier": "url", "manifest": "url", "quarantine": "event_id", "visited": "norm_url", "health": "concat(host, ' ', failures, ' ', total)"}
    rows = [back[n].select(F.lit(version).alias("version"), F.lit(n).alias("name"), F.expr(k).cast("string").alias("key")) for n, k in keys.items()]
    return reduce(DataFrame.unionByName, rows)


@query("s14_clamp_settings")
def _(spark, sf):
    events = I.project(I.table(spark, sf, "events"), I.SETTINGS)
    rows = events.select(
        "event_id",
        F.create_map(*[x for k in I.SETTING_KEYS for x in (F.lit(k), F.col(k))]).alias("settings"),
    )
    fixed = Tk.clamp_settings(rows)
    return fixed.select("event_id", *[F.col("settings")[k].alias(k) for k in I.SETTING_KEYS])


# --- URL functions ---------------------------------------------------------------


def corpus(spark, sf) -> DataFrame:
    return I.url_corpus(media_pages(spark, sf))


def url_query(name: str, pair: bool = False, **columns):
    """Functions of the distinct corpus URLs, or of (base, url) pairs."""

    @query(name)
    def run(spark, sf):
        c = corpus(spark, sf)
        c = c.select("base", "url").distinct() if pair else c.select("url").distinct()
        return c.select(*c.columns, *[make().alias(n) for n, make in columns.items()])


url_query(
    "u01_url_parts",
    scheme=lambda: U.url_parts("url")["scheme"], netloc=lambda: U.url_parts("url")["netloc"],
    path=lambda: U.url_parts("url")["path"], query=lambda: U.url_parts("url")["query"],
    fragment=lambda: U.url_parts("url")["fragment"],
)
url_query("u02_is_valid_url", valid=lambda: U.is_valid_url("url"), bare=lambda: U.is_valid_url(U.path("url")))
url_query("u03_normalize_url", norm=lambda: U.normalize_url("url"))
url_query("u04_get_domain", domain=lambda: U.get_domain("url"))
url_query("u05_base_domain", True, base_domain=lambda: U.base_domain("url"), same=lambda: U.is_same_domain("base", "url"))


@query("u06_url_join")
def _(spark, sf):
    rows = I.pages(spark, sf).select("page_id", "url", F.explode(F.array(*map(F.lit, I.REFS))).alias("ref"))
    return rows.select("page_id", "ref", U.url_join("url", "ref").alias("joined"))


url_query("u07_path_segments", segments=lambda: joined(U.path_segments("url")))
url_query("u08_is_image_url", hit=lambda: U.is_image_url("url"))
url_query("u09_is_trash_media", hit=lambda: U.is_trash_media("url"))
url_query("u10_is_media_url", hit=lambda: U.is_media_url("url"))
url_query("u11_is_video_url", hit=lambda: U.is_video_url("url"))
url_query("u12_is_webpage_url", hit=lambda: U.is_webpage_url("url"))
url_query("u13_should_skip_crawl_url", hit=lambda: U.should_skip_crawl_url("url", K.STOP_WORDS + ["en", "moved"]))
url_query("u14_is_cdn_url", img=lambda: U.is_cdn_url("url", "img"), video=lambda: U.is_cdn_url("url", "video"))
url_query("u15_video_platform", platform=lambda: U.video_platform("url"))
url_query("u16_guess_media_type", kind=lambda: U.guess_media_type("url"))
url_query(
    "u17_is_json_endpoint",
    hit=lambda: U.is_json_endpoint("url"),
    api=lambda: U.is_json_endpoint(F.concat("url", F.lit("/api/x"))),
    param=lambda: U.is_json_endpoint(F.concat("url", F.lit("&format=json"))),
)
url_query(
    "u18_looks_like_url",
    hit=lambda: U.looks_like_url("url"),
    bare=lambda: U.looks_like_url(F.regexp_replace("url", "^https?://", "")),
    last=lambda: U.looks_like_url(U.file_basename("url")),
)


@query("u19_is_media_key")
def _(spark, sf):
    word = F.explode(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+")).alias("key")
    return I.pages_media(spark, sf).select(word).distinct().select("key", U.is_media_key("key").alias("hit"))


def _img_attrs(spark, sf) -> DataFrame:
    """URLs with sizes, class, id and alt text that follow from the page."""
    rows = I.image_urls(spark, sf)
    return rows.selectExpr("page_id", "url", *[f"{e} AS {n}" for n, e in I.IMAGE_ATTRS.items()])


@query("u20_is_banner_or_ad")
def _(spark, sf):
    rows = _img_attrs(spark, sf)
    return rows.select("*", U.is_banner_or_ad("url", "width", "height", "css", "dom_id", "alt").alias("ad"))


@query("u21_is_significant")
def _(spark, sf):
    rows = _img_attrs(spark, sf)
    return rows.select("page_id", "url", U.is_significant("url", "width", "height", "css", "dom_id", "alt").alias("significant"))


url_query("u22_is_junk_url", hit=lambda: U.is_junk_url("url"))
url_query("u23_is_likely_content", hit=lambda: U.is_likely_content("url"))
url_query(
    "u24_is_homepage",
    home=lambda: U.is_homepage("url"),
    root=lambda: U.is_homepage(F.regexp_replace("url", r"^(https?://[^/]+/?).*?(\?.*)?$", "$1$2")),
    nav=lambda: U.nav_count("url"),
)
url_query("u25_is_related", True, related=lambda: U.is_related("url", "base"), back=lambda: U.is_related("base", "url"))
url_query("u26_common_prefix_len", True, n=lambda: U.common_prefix_len("base", "url"))
url_query(
    "u27_filename_from_url",
    image=lambda: U.filename_from_url("url", F.lit("image")), video=lambda: U.filename_from_url("url", F.lit("video")),
    root=lambda: U.filename_from_url(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("image")),
)


@query("u28_sanitize_filename")
def _(spark, sf):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    rows = I.pages(spark, sf).select("page_id", title.alias("title"), "url")
    return rows.select(
        "page_id",
        U.sanitize_filename("title").alias("from_title"),
        U.sanitize_filename("url").alias("from_url"),
        U.sanitize_filename(F.concat(F.lit("??"), F.lit("."), F.lit("jpg"))).alias("hashed"),
        U.sanitize_filename(F.repeat("title", 9)).alias("long_name"),
    )


url_query("u29_target_dir", dir=lambda: U.target_dir("url"))
url_query("u30_file_basename", base_name=lambda: U.file_basename("url"))


@query("u31_task_folder")
def _(spark, sf):
    t = I.tasks(spark, sf)
    return t.select("id", U.task_folder("url", "created_at").alias("folder"), U.task_folder("id", "created_at").alias("other"))


@query("u32_referer_for")
def _(spark, sf):
    policy = F.element_at(F.array(F.lit("auto"), F.lit("origin"), F.lit("none")), (F.col("page_id") % 3 + 1).cast("int"))
    p = I.pages(spark, sf).select("page_id", policy.alias("policy"), "url")
    return p.select("page_id", "policy", U.referer_for("policy", "url").alias("referer"))


# --- page markup -----------------------------------------------------------------


@query("h01_nodes")
def _(spark, sf):
    n = all_nodes(spark, sf)
    a = F.col("attrs")
    return n.select(
        "page_id", "node_id", "tag", a["href"].alias("href"), a["src"].alias("src"), a["class"].alias("css"),
        F.size("attrs").alias("n_attrs"),
    )


@query("h01_node_counts")
def _(spark, sf):
    return all_nodes(spark, sf).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("h02_parse_srcset")
def _(spark, sf):
    rows = I.srcsets(spark, sf).select("page_id", F.posexplode(Rw.parse_srcset("srcset")).alias("pos", "c"))
    return rows.select("page_id", "pos", "c.url", "c.width")


@query("h03_largest_srcset")
def _(spark, sf):
    s = I.srcsets(spark, sf)
    return s.select("page_id", Rw.largest_srcset("srcset").alias("by_width"), Rw.largest_srcset("srcset", True).alias("by_browser"))


@query("h04_visible")
def _(spark, sf):
    n = all_nodes(spark, sf).filter(F.col("tag").isin("a", "img", "div", "p"))
    return n.select("page_id", "node_id", "tag", is_visible().alias("visible"))


@query("h05_best_image")
def _(spark, sf):
    n = page_nodes(spark, sf).filter(F.col("tag") == "img")
    best = n.select("page_id", "node_id", F.explode(F.array(M.best_image(F.col("attrs")))).alias("b"))
    return best.select("page_id", "node_id", "b.url", "b.rank", "b.source", "b.width", "b.height")


def _media_of(spark, sf, *candidates) -> DataFrame:
    return M.extract(page_nodes(spark, sf), *candidates).select("page_id", "media_type", "url", "source")


@query("h06_picture_images")
def _(spark, sf):
    found = M.extract(page_nodes(spark, sf), M.picture_images())
    return found.select("page_id", "url", "source", "width", F.col("attrs")["media"].alias("media"))


@query("h07_img_images")
def _(spark, sf):
    found = M.extract(page_nodes(spark, sf), M.img_images())
    return found.select("page_id", "url", "source", "transformed", "original_url")


def requoted(pages: DataFrame) -> DataFrame:
    """The same pages as others write them: a third in single quotes, a third with link targets unquoted.  Scripts,
    and attributes that hold a single quote, stay as they are."""
    pieces = F.split("html", "(?i)(?=<script[\\s>])|(?<=</script>)")

    def outside(change):
        return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("(?i)^<script[\\s>]"), x).otherwise(change(x))), "")

    bare = outside(lambda x: F.regexp_replace(x, '<a href="([^" >]*)">', "<a href=$1>"))
    single = outside(lambda x: F.regexp_replace(x, """([\\w:-]+)="([^"'<>]*)\"""", "$1='$2'"))
    html = F.when(F.col("page_id") % 3 == 1, single).when(F.col("page_id") % 3 == 2, bare).otherwise(F.col("html"))
    return pages.withColumn("html", html)


@query("h07_img_images_requoted_all")
def _(spark, sf):
    """Images of pages whose attributes are quoted in other ways."""
    found = M.extract(nodes(requoted(media_pages(spark, sf)), marked_only=True), M.img_images())
    return found.select("page_id", "url", "source", "transformed", "original_url")


@query("h07_img_images_min_size")
def _(spark, sf):
    """Images with the smallest width a task asks for: wider than any in a ``srcset``."""
    settings = M.Settings(min_width=2500)
    found = M.extract(page_nodes(spark, sf), M.img_images(settings=settings))
    return found.select("page_id", "url", "source", "transformed", "original_url")


@query("h07_img_links")
def _(spark, sf):
    links = L.image_links(page_nodes(spark, sf))
    return links.select("page_id", "url", "thumbnail_url", "priority")


@query("h08_css_images")
def _(spark, sf):
    return _media_of(spark, sf, M.css_images())


@query("h09_icon_images")
def _(spark, sf):
    return _media_of(spark, sf, M.icon_images())


@query("h10_meta_images")
def _(spark, sf):
    return _media_of(spark, sf, M.meta_images())


@query("h11_video_tags")
def _(spark, sf):
    found = M.extract(page_nodes(spark, sf), M.video_tags())
    return found.select("page_id", "url", "is_cdn", F.col("attrs")["poster"].alias("poster"), F.col("attrs")["type"].alias("kind"))


@query("h12_video_embeds")
def _(spark, sf):
    return M.extract(page_nodes(spark, sf), M.video_embeds()).select("page_id", "url", "platform")


@query("h13_meta_videos")
def _(spark, sf):
    """The page's preview tag re-read as a video preview."""
    pages = media_pages(spark, sf).withColumn("html", F.replace("html", F.lit("og:image"), F.lit("og:video")))
    return M.extract(nodes(pages), M.meta_videos()).select("page_id", "media_type", "url", "source", "platform")


@query("h14_jsonld_media")
def _(spark, sf):
    return _media_of(spark, sf, M.jsonld_media(None))


@query("h15_js_media")
def _(spark, sf):
    return _media_of(spark, sf, M.js_media())


@query("h16_data_attr_media")
def _(spark, sf):
    return _media_of(spark, sf, M.data_attr_media())


@query("h17_lazy_media")
def _(spark, sf):
    return _media_of(spark, sf, M.lazy_media())


@query("h18_framework_media")
def _(spark, sf):
    """Plain image sources re-written as the lazy attribute of a front-end framework."""
    at = F.concat(F.lit('<img v-lazy="'), F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/"))
    pages = media_pages(spark, sf).withColumn("html", F.replace("html", F.lit('<img src="/'), at))
    return M.extract(nodes(pages), M.framework_media()).select("page_id", "media_type", "url", "source")


def _link_columns(df) -> DataFrame:
    return df.select("page_id", "url", "from_image", "element", "text", "priority", "thumbnail_url")


@query("h19_links")
def _(spark, sf):
    return _link_columns(L.links(page_nodes(spark, sf)))


@query("h19_links_hidden_too")
def _(spark, sf):
    """Links of pages that hide their menus, with the filter for hidden links switched off."""
    pages = media_pages(spark, sf).withColumn("html", F.replace("html", F.lit("<li>"), F.lit('<li style="display:none">')))
    found = L.links(nodes(pages, marked_only=True), M.Settings(filter_hidden=False))
    return _link_columns(found)


@query("h19_links_requoted")
def _(spark, sf):
    """Links of pages whose attributes are quoted in other ways."""
    return _link_columns(L.links(nodes(requoted(media_pages(spark, sf)), marked_only=True)))


@query("h20_canonical_link")
def _(spark, sf):
    return L.canonical_link(page_nodes(spark, sf)).select("page_id", "url", "priority")


@query("h21_js_redirect")
def _(spark, sf):
    return L.redirects(I.pages_media(spark, sf)).select("page_id", "target", "dst")


@query("h22_resolve_redirects")
def _(spark, sf):
    return L.resolve_redirects(I.redirect_chains(spark, sf))


@query("h23_gateway_candidates")
def _(spark, sf):
    return L.gateway_candidates(page_nodes(spark, sf)).select("page_id", "url", "method", "text", "score")


@query("h24_scan_page")
def _(spark, sf):
    return S.scan_page(page_nodes(spark, sf)).select("page_id", "url", "media_type", "source", "alt")


@query("h24_scan_links")
def _(spark, sf):
    return S.scan_links(page_nodes(spark, sf)).select("page_id", "url")


@query("h25_img_src_regex")
def _(spark, sf):
    """Image sources of raw markup, made absolute first as a page with full URLs has them."""
    at = F.concat(F.lit('<img src="'), F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/"))
    pages = I.pages_media(spark, sf).withColumn("html", F.replace("html", F.lit('<img src="/'), at))
    return S.img_src_regex(pages).select("page_id", "pos", "img_url")


# --- JSON payloads -----------------------------------------------------------------


@query("j01_json_walk")
def _(spark, sf):
    return J.json_walk(_payloads(spark, sf)).select("doc_id", "path", "key", "kind")


@query("j02_json_media")
def _(spark, sf):
    return J.json_media(_payloads(spark, sf)).select("doc_id", "url", "outcome", "media_type", "source", "pos")


@query("j03_json_page_links")
def _(spark, sf):
    return J.json_page_links(_payloads(spark, sf)).select("doc_id", "key", "url")


# --- rewriting -----------------------------------------------------------------------


@query("r01_match_site_patterns")
def _(spark, sf):
    return R.match_site_patterns(I.image_urls(spark, sf), book(spark))


@query("r02_apply_replace_patterns")
def _(spark, sf):
    return R.replace_by_site(I.image_urls(spark, sf), book(spark)).select("page_id", "url", "replaced_url")


def _index(spark) -> RuleIndex:
    return RuleIndex(I.rules_table(spark), I.patterns_table(spark), I.THUMBNAILS)


@query("r01_match_site_patterns_by_join")
def _(spark, sf):
    return RuleIndex(None, I.patterns_table(spark)).match_sites(I.image_urls(spark, sf))


@query("r02_apply_replace_patterns_by_join")
def _(spark, sf):
    found = RuleIndex(None, I.patterns_table(spark)).replaced(I.image_urls(spark, sf))
    return found.withColumnRenamed("first", "replaced_url")


@query("r03_rule_candidates")
def _(spark, sf):
    found = R.rule_candidates(I.image_urls(spark, sf), book(spark))
    return found.select("page_id", "url", joined(F.transform("candidates", lambda c: c.cast("string"))).alias("candidates"))


@query("r04_apply_rules")
def _(spark, sf):
    return R.apply_rules(I.image_urls(spark, sf), book(spark))


@query("r04_apply_rules_by_join")
def _(spark, sf):
    found = R.apply_rules_by_join(I.image_urls(spark, sf), I.rules_table(spark))
    return found.select("page_url", "url", "ord", "pos", "variant")


@query("r04_apply_rules_per_page")
def _(spark, sf):
    """As many rules as pages and hosts: one for every page's thumbnail, and one bound to every page's host."""
    fields = ["rule_id", "ord", "domain", "link", "img", "to", "res"]
    none = [F.lit(None).cast("string").alias("link"), F.array().cast("array<string>").alias("res")]
    pages = I.pages(spark, sf)
    n = F.col("page_id").cast("string")
    thumbs = pages.select(
        F.col("page_id").cast("int").alias("rule_id"), F.col("page_id").cast("int").alias("ord"), F.lit(None).cast("string").alias("domain"),
        F.concat(F.lit("/images/thumb/img"), n, F.lit("_thumb[.]jpg$")).alias("img"), F.concat(F.lit("/images/big/"), n, F.lit(".jpg")).alias("to"), *none,
    )
    hosts = I.page_hosts(spark, sf).select(
        F.lit(0).alias("rule_id"), F.lit(-1).alias("ord"), F.col("host").alias("domain"),
        F.lit(r"^(.*)/pics/(\d+)-300x200[.]jpg$").alias("img"), F.lit("$1/pics/$2.jpg").alias("to"), *none,
    )
    index = RuleIndex(thumbs.select(fields).unionByName(hosts.select(fields)))
    return index.hits(I.image_urls(spark, sf)).select("page_url", "url", "ord", "pos", "variant")


@query("r05_apply_rules_first")
def _(spark, sf):
    urls = I.image_urls(spark, sf)
    first = S.first_rule(F.col("url"), F.col("page_url"), book(spark))
    return urls.select("page_id", "url", first.alias("result"))


@query("r06_expand_variants")
def _(spark, sf):
    text = F.concat(
        F.lit(" /f/"), F.col("page_id").cast("string"), F.lit(".#jpg png#?s=#s  m l#\n\n/g/"),
        F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".#webp#").otherwise(".gif"),
    )
    rows = I.pages(spark, sf).select("page_id", F.posexplode(Rw.expand_variants(text)).alias("pos", "variant"))
    return rows


@query("r07_global_transforms")
def _(spark, sf):
    b = book(spark)
    urls = I.image_urls(spark, sf)
    return urls.select("page_id", "url", Rw.apply_replacements("url", b.thumbnail_replacements()).alias("result"))


@query("r08_strip_size_suffix")
def _(spark, sf):
    urls = I.image_urls(spark, sf)
    return urls.select("page_id", "url", Rw.strip_size_suffix("url").alias("result"))


@query("r09_transform_image_url")
def _(spark, sf):
    return R.transform_image_urls(I.image_urls(spark, sf), book(spark))


@query("r09_transform_image_url_by_join")
def _(spark, sf):
    return _index(spark).transform(I.image_urls(spark, sf))


@query("r10_rule_functions")
def _(spark, sf):
    e = I.table(spark, sf, "events")
    kinds = ["group", "concat", "if", "replace", "base64", "urldecode"]
    fn = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 6 + 1).cast("int"))
    first = F.when(fn == "base64", F.base64(F.col("props").cast("binary"))).when(
        fn == "urldecode", F.concat(F.replace(F.url_encode("props"), F.lit("+"), F.lit("%20")), F.lit("+"))
    ).when(fn == "if", F.when(F.col("event_id") % 4 == 0, "").otherwise("x")).otherwise(F.col("event_type"))
    args = F.array(first, F.when(fn == "replace", "i").otherwise("/a/"), F.col("event_id").cast("string"))
    return e.select("event_id", fn.alias("fn"), R.rule_function(fn, args).alias("result"))


def _linked(spark, sf) -> DataFrame:
    """Links between pages in the form a browser scan hands over."""
    e = I.page_links(spark, sf)
    links = e.select("page_id", F.col("src_url").alias("page_url"), F.col("dst_url").alias("url"), F.col("dst_url").alias("first_seen"))
    return S.cap_links(links)


@query("r11_discover_fullsize")
def _(spark, sf):
    return S.discover_fullsize(_linked(spark, sf), I.pages_media(spark, sf), book(spark))


@query("r12_resolve_url")
def _(spark, sf):
    items = I.page_links(spark, sf).select("page_id", F.col("dst_url").alias("url"))
    return S.resolve_url(items, I.pages_media(spark, sf), book(spark))


@query("r13_transform_media")
def _(spark, sf):
    return S.transform_media(I.image_urls(spark, sf), book(spark)).select("page_id", "url", "original", "transformed")


# --- joins ---------------------------------------------------------------------------


def _edges(spark, sf) -> DataFrame:
    return I.page_links(spark, sf).select("page_id", F.col("src_url").alias("page_url"), F.col("dst_url").alias("url"))


@query("n01_not_blocked")
def _(spark, sf):
    return Fr.not_blocked(_edges(spark, sf), I.blocklist(spark))


@query("n02_not_visited")
def _(spark, sf):
    """Links to pages that are not feed entries, which count as visited."""
    seen = I.pages(spark, sf).filter(F.col("url").contains("utm_source=feed")).select(U.normalize_url("url").alias("norm_url"))
    return Fr.not_visited(_edges(spark, sf), seen)


@query("n03_not_queued")
def _(spark, sf):
    """Image URLs of the pages, less those a page shows in its own markup already."""
    shown = page_media(spark, sf).select(U.normalize_url("url").alias("norm_url"))
    return Mf.not_queued(I.image_urls(spark, sf).select("page_id", "url"), shown)


def _health(spark, sf) -> DataFrame:
    return H.host_health(H.outcomes(fetches(spark, sf)))


@query("n04_set_aside")
def _(spark, sf):
    items = I.fetch_log(spark, sf).select("event_id", "host")
    return H.set_aside(items, H.quarantined(_health(spark, sf)))


@query("n05_node_relatives")
def _(spark, sf):
    n = all_nodes(spark, sf)
    up = with_relative(n, "parent_id", {"tag": "parent_tag"})
    linked = with_relative(up, "anchor_id", {"tag": "anchor_tag"})
    return linked.filter(F.col("tag").isin("img", "source", "li", "a")).select(
        "page_id", "node_id", "tag", "parent_tag", "anchor_tag"
    )


@query("n06_linked_pages")
def _(spark, sf):
    links = _edges(spark, sf).select("page_id", U.normalize_url("url").alias("norm_url"))
    pages = I.pages(spark, sf).select(U.normalize_url("url").alias("norm_url"), F.length("html").cast("bigint").alias("n_chars"))
    return links.join(pages, "norm_url")


@query("n07_rule_hits")
def _(spark, sf):
    urls = I.image_urls(spark, sf)
    hits = F.explode(book(spark).rule_hits(F.col("url"), F.col("page_url")))
    return urls.select("page_id", "url", hits.alias("h")).select("page_id", "url", "h.rule_id")


def _page_counts(spark, sf, media=None) -> DataFrame:
    """Media found per page, zero included."""
    media = page_media(spark, sf) if media is None else media
    found = media.groupBy("page_id").agg(F.count("*").alias("n"))
    pages = I.pages(spark, sf).select("page_id", F.col("url").alias("page_url"))
    return pages.join(found, "page_id", "left").select("page_id", "page_url", F.coalesce("n", F.lit(0)).alias("n_media"))


@query("n08_frontier_scores")
def _(spark, sf):
    rows = _edges(spark, sf).select("page_id", "url")
    return Fr.with_host_score(rows, Fr.host_scores(_page_counts(spark, sf))).select("page_id", "url", "host_score")


@query("n09_same_site")
def _(spark, sf):
    links = _edges(spark, sf).withColumn("task_id", F.col("page_id"))
    return Fr.same_site(links, I.tasks(spark, sf)).select("task_id", "url")


# --- aggregates ------------------------------------------------------------------------


def _outcomes(spark, sf) -> DataFrame:
    return H.outcomes(fetches(spark, sf))


@query("a01_counters")
def _(spark, sf):
    return H.counters(_outcomes(spark, sf), I.pages(spark, sf))


@query("a02_progress")
def _(spark, sf):
    """Progress per media type; the stats of a run that has found twice as much as it tried."""
    by_type = _outcomes(spark, sf).groupBy("media_type").agg(
        (F.count_if(F.col("media_type") == "image") * 2).alias("images_found"),
        (F.count_if(F.col("media_type") == "video") * 2).alias("videos_found"),
        F.count_if(F.col("success")).alias("files_downloaded"),
        F.count_if(~F.col("success")).alias("files_skipped"),
    )
    return H.progress(by_type).select("media_type", "percent")


@query("a03_host_reputation")
def _(spark, sf):
    return Fr.host_scores(_page_counts(spark, sf))


@query("a04_pattern_scores")
def _(spark, sf):
    """Word scores over link targets: pages in id order, with media on some of them."""
    rows = page_media(spark, sf).select("page_id", F.col("url").alias("page_url"), "media_type", "stage", "owner", "pos")
    steps = rows.select(
        "page_id", "stage", "owner", "pos", "page_url", F.when(F.col("page_id") % 3 == 0, 0).otherwise(1).alias("n_media")
    )
    return Fr.pattern_scores(steps, ["page_id", "stage", "owner", "pos", "page_url"])


@query("a05_media_per_host")
def _(spark, sf):
    return Mf.per_host(page_media(spark, sf))


@query("a06_host_health")
def _(spark, sf):
    return _health(spark, sf)


@query("a06_user_health")
def _(spark, sf):
    """Errors as failures and everything else as successes, per user."""
    e = I.table(spark, sf, "events")
    fetches = e.select(
        "user_id", "ts", "event_id", (F.col("event_type") != "error").alias("success"), F.lit(False).alias("content_skip")
    )
    return H.host_health(fetches, "user_id")


@query("a07_status_summary")
def _(spark, sf):
    return Tk.status_summary(I.tasks(spark, sf))


@query("a08_import_counts")
def _(spark, sf):
    return Tk.outcome_counts(_imported(spark, sf))


@query("a09_media_counts")
def _(spark, sf):
    return Mf.media_counts(page_media(spark, sf))


def _items(spark, sf) -> DataFrame:
    """Scanned media of each page with what its linked pages yield."""
    seen = S.scan_page(page_nodes(spark, sf)).select("page_id", "page_url", "url", "media_type", "source")
    return seen.unionByName(S.discover_fullsize(_linked(spark, sf), I.pages_media(spark, sf), book(spark)))


@query("a10_fullsize_or_all")
def _(spark, sf):
    return S.fullsize_or_all(settled(_items(spark, sf))).select("page_id", "url", "source")


@query("a11_rule_counts")
def _(spark, sf):
    return R.rule_counts(P.parse_rules(_rule_files(spark, sf)), P.parse_site_patterns(_pattern_files(spark, sf)))


# --- ranking -----------------------------------------------------------------------------


def _frontier(spark, sf) -> DataFrame:
    """Every corpus URL as a link of its page, at a depth that follows from the page."""
    c = corpus(spark, sf)
    return c.select(
        "page_id",
        "url",
        (F.col("page_id") % 4).cast("int").alias("depth"),
        F.col("base").alias("source_url"),
        F.when(F.col("page_id") % 2 == 0, F.col("base")).alias("start_url"),
        F.col("base").alias("context_url"),
        F.when(F.col("page_id") % 5 == 0, 15.0).alias("priority_hint"),
        (F.col("page_id") % 3 == 0).alias("from_image"),
        (F.col("page_id") % 7 == 0).alias("interstitial_retry"),
    )


WORD_SCORES = {"media": 3, "pic": 1, "gallery": 0, "post": 2}


def _scored(spark, sf) -> DataFrame:
    rows = Fr.with_host_score(_frontier(spark, sf), Fr.host_scores(_page_counts(spark, sf)))
    return Fr.scored(rows, WORD_SCORES)


@query("k01_url_priority")
def _(spark, sf):
    return _scored(spark, sf).select("page_id", "url", F.round("priority", 6).alias("priority"))


@query("k02_admission")
def _(spark, sf):
    return Fr.admit(_scored(spark, sf)).select("page_id", "url", F.round("priority", 6).alias("priority"))


@query("k03_pop_order")
def _(spark, sf):
    rows = Fr.admit(_scored(spark, sf)).select(
        "page_id", "url", "depth", F.round("priority", 6).alias("priority")
    )
    return global_rank(rows, [F.desc("priority"), "depth", "url", "page_id"], "pop_order")


@query("k04_cap_links")
def _(spark, sf):
    """Best five links of each page by explicit priority."""
    return Fr.cap_per_page(L.extract_links(page_nodes(spark, sf)), 5).select("page_id", "url", "priority")


@query("k05_media_priority")
def _(spark, sf):
    m = page_media(spark, sf).withColumn("start_url", F.when(F.col("page_id") % 2 == 0, F.col("page_url")))
    return m.select("page_id", "url", "source", F.round(Mf.media_priority("start_url"), 6).alias("priority"))


@query("k06_first_wins")
def _(spark, sf):
    return Mf.first_wins(page_media(spark, sf)).select("norm_url", "page_id", "media_type", "source")


@query("k07_file_limit")
def _(spark, sf):
    return H.file_limit(_outcomes(spark, sf), 100).select("event_id", "success")


@query("k08_best_gateway")
def _(spark, sf):
    n = stored_nodes(spark, sf)
    return L.best_gateway(n, I.pages_media(spark, sf), M.extract_media(n))


def _manifest(spark, sf) -> DataFrame:
    return Mf.to_manifest(Mf.with_route(Mf.first_wins(page_media(spark, sf))))


def _crowded(spark, sf) -> DataFrame:
    """Manifest rows whose names clash: a few names per folder, some already numbered."""
    rows = I.image_urls(spark, sf).select("page_id", F.col("url")).distinct()
    name = F.concat(
        F.lit("img"),
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("_"), (F.col("page_id") % 4 + 1).cast("string"))).otherwise(""),
        F.lit(".jpg"),
    )
    return rows.select("url", U.get_domain("url").alias("dir"), name.alias("filename"), F.lit("image").alias("media_type"))


@query("k09_unique_names")
def _(spark, sf):
    return Mf.unique_names(_crowded(spark, sf)).select("url", "dir", "filename", "unique_name")


@query("k10_politeness_waves")
def _(spark, sf):
    m = _manifest(spark, sf).select("url", "host", F.round("priority", 6).alias("priority"))
    return Mf.waves(m)


@query("k11_quarantine_batches")
def _(spark, sf):
    log = I.fetch_log(spark, sf)
    items = H.set_aside(log.select("event_id", "ts", "host"), H.quarantined(_health(spark, sf)))
    queue = items.withColumn("retries", (F.col("event_id") % 2).cast("int"))
    return H.quarantine_batches(queue).select("event_id", "host", "batch", "action")


@query("k12_cap_linked_pages")
def _(spark, sf):
    """First three links of each page's browser scan."""
    return S.cap_links(S.scan_links(page_nodes(spark, sf)), 3).select("page_id", "url", "rank")


@query("k13_queue_order")
def _(spark, sf):
    return Tk.queue_order(I.tasks(spark, sf)).select("id", "status", "position")


@query("k13_next_task")
def _(spark, sf):
    return Tk.next_task(I.tasks(spark, sf)).select("id", "url", "status")


@query("k14_byte_ranges")
def _(spark, sf):
    files = I.fetch_log(spark, sf).select(
        "event_id", (F.col("content_length") * 40).alias("content_length"), (F.col("event_id") % 3 != 0).alias("accepts_ranges")
    )
    return Mf.byte_ranges(files, 6).select("event_id", "parts", "part", "first_byte", "last_byte")


# --- projections, filters, set operations ----------------------------------------------------


@query("f01_extract_media")
def _(spark, sf):
    return page_media(spark, sf).select("page_id", "media_type", "url", "source", "is_cdn")


@query("f01_extract_media_with_rules")
def _(spark, sf):
    m = M.extract_media(page_nodes(spark, sf), book(spark))
    return m.filter(F.col("transformed")).select("page_id", "url", "original_url")


@query("f02_extract_links")
def _(spark, sf):
    return _link_columns(L.extract_links(page_nodes(spark, sf)))


@query("f03_ordered_distinct")
def _(spark, sf):
    """Distinct targets of each page's anchors, in order of first sight."""
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]+)"'), 1))
    rows = I.pages(spark, sf).select("page_id", F.posexplode(refs).alias("pos", "href"))
    return rows


@query("f04_filter_links")
def _(spark, sf):
    n = stored_nodes(spark, sf)
    links = L.extract_links(n).withColumn("start_url", F.col("page_url"))
    hosts = Fr.host_scores(_page_counts(spark, sf, M.extract_media(n)))
    out = Fr.filter_links(links, I.blocklist(spark), F.col("page_id") % 4, scores=WORD_SCORES, hosts=hosts)
    return out.select("page_id", "url", "depth", F.round("priority", 6).alias("priority"))


@query("f05_route_media")
def _(spark, sf):
    """Media of the pages and their plain links, routed; first sighting of each URL."""
    m = page_media(spark, sf).select("page_id", "page_url", "url", "media_type")
    extra = corpus(spark, sf).select("page_id", F.col("base").alias("page_url"), "url", F.lit("file").alias("media_type"))
    rows = m.unionByName(extra).select(U.normalize_url("url").alias("norm_url")).distinct()
    return Mf.with_route(rows)


@query("f06_one_shot")
def _(spark, sf):
    return Tk.without_one_shot_links(_edges(spark, sf).withColumn("task_id", F.col("page_id")), I.tasks(spark, sf)).select(
        "task_id", "url"
    )


@query("f07_fetch_outcome")
def _(spark, sf):
    """With the received length off by one on some fetches."""
    got = F.col("content_length") + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)
    return I.fetch_log(spark, sf).withColumn("got", got).select("event_id", H.fetch_error("got").alias("error"))


@query("f08_fetch_status")
def _(spark, sf):
    return I.fetch_log(spark, sf).select("event_id", H.fetch_status("status").alias("result"), H.is_rate_limited("status").alias("limited"))


@query("f09_content_skip")
def _(spark, sf):
    return _outcomes(spark, sf).select("event_id", "success", "content_skip")


@query("f10_interstitial_feedback")
def _(spark, sf):
    rows = _outcomes(spark, sf).withColumn("interstitial_retry", F.col("event_id") % 4 == 0)
    return H.interstitial_feedback(rows)


@query("f11_filter_items")
def _(spark, sf):
    items = settled(_items(spark, sf).select("page_id", "url", "source"))
    full = S.filter_items(items, view="fullsize").withColumn("view", F.lit("fullsize"))
    thumbs = S.filter_items(items, view="thumbnail").withColumn("view", F.lit("thumbnail"))
    one = S.filter_items(items, host="player.vimeo.com").withColumn("view", F.lit("host"))
    return full.unionByName(thumbs).unionByName(one)


@query("f12_probation")
def _(spark, sf):
    return H.probation(I.fetch_log(spark, sf).select("event_id", "host"), _health(spark, sf))


@query("f13_task_status")
def _(spark, sf):
    return Tk.task_status(I.task_events(spark, sf))


@query("s15_write_manifest")
def _(spark, sf):
    path = scratch(spark, "manifest")
    Mf.write_manifest(_manifest(spark, sf), path)
    return spark.read.parquet(path).select("url", "dir", "filename", "host")


# --- crawl -------------------------------------------------------------------------------------


@query("c01_crawl")
def _(spark, sf):
    """Crawl from the feed entries over the page links, three levels."""
    pages = I.pages(spark, sf).select("page_id", "url")
    links = _edges(spark, sf).withColumns(
        {"first_seen": F.col("url"), "priority": F.lit(None).cast("double"), "from_image": F.lit(False)}
    )
    seeds = pages.filter(F.col("url").contains("utm_source=feed"))
    seen = crawl(pages, links, seeds, I.blocklist(spark), max_depth=2, stay_in_domain=False, page_media=_page_counts(spark, sf).drop("page_url"))
    return seen.select("page_id", "norm_url", "depth")


@query("c01_crawl_per_task")
def _(spark, sf):
    """A task for every page, each walking two levels by itself; their pages overlap."""
    pages = I.pages(spark, sf).select("page_id", "url")
    links = _edges(spark, sf).withColumns(
        {"first_seen": F.col("url"), "priority": F.lit(None).cast("double"), "from_image": F.lit(False)}
    )
    seeds = pages.select(F.col("page_id").alias("task_id"), "url")
    seen = crawl(pages, links, seeds, I.blocklist(spark), max_depth=2, stay_in_domain=False)
    return seen.select("task_id", "page_id", "depth")


def _crossed(spark, sf, factor: int, step: int) -> DataFrame:
    """An edge from every page to another one: page_id, src_url, dst_url."""
    p = I.pages(spark, sf).select("page_id", "url")
    to = p.withColumn("dst_id", (F.col("page_id") * factor + step) % p.agg(F.count("*")).scalar())
    dst = p.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst_url"))
    return to.withColumnRenamed("url", "src_url").join(dst, "dst_id").select("page_id", "src_url", "dst_url")


@query("c03_crawl_feedback")
def _(spark, sf):
    """A task for every page, best first within its own domain, over what the pages hold.

    Links come from the markup and from a JSON listing of each page; some media of a page are web pages, and some downloads bring one.
    The buckets are wide: feedback has no depth limit, so a task reaches most of its domain, and few pages wait at a time.
    """
    pages = I.pages(spark, sf).select("page_id", "url")
    anchors = I.page_links(spark, sf).groupBy("page_id").agg(
        F.array_join(F.collect_list(F.concat(F.lit('<a href="'), "dst_url", F.lit('">more</a>'))), "").alias("anchors")
    )
    marked = media_pages(spark, sf).join(anchors, "page_id").withColumn("html", F.concat("html", "anchors")).drop("anchors")
    found = settled(nodes(marked, marked_only=True))
    columns = ["page_id", "page_url", "url", "first_seen", "priority", "from_image"]
    listing = _crossed(spark, sf, 11, 5).select(
        F.col("page_id").alias("doc_id"), F.col("src_url").alias("url"), F.concat(F.lit('{"next":"'), "dst_url", F.lit('"}')).alias("body")
    )
    paging = J.json_page_links(J.read_payloads(listing)).select(
        F.col("doc_id").alias("page_id"), "page_url", "url",
        F.struct(F.lit(9).alias("stage"), F.lit(0).alias("owner"), F.lit(0).cast("bigint").alias("pos")).alias("first_seen"),
        F.lit(None).cast("double").alias("priority"), F.lit(False).alias("from_image"),
    )
    media = M.extract_media(found).select("page_id", "url").unionByName(_crossed(spark, sf, 13, 3).select("page_id", F.col("dst_url").alias("url")))
    refused = _crossed(spark, sf, 17, 7).select("page_id", F.col("dst_url").alias("url"))
    seen = best_first_crawl(
        pages, L.extract_links(found).select(columns).unionByName(paging), pages.select(F.col("page_id").alias("task_id"), "url"),
        I.blocklist(spark), media, refused, max_depth=2, ratio=1e6, columns=("task_id", "page_id", "depth", "round"),
    )
    return seen.select("task_id", "page_id", "depth", "round")


@query("c02_visit_rank")
def _(spark, sf):
    pages = I.pages(spark, sf).select("page_id", "url")
    links = _edges(spark, sf).withColumns(
        {"first_seen": F.col("url"), "priority": F.lit(None).cast("double"), "from_image": F.lit(False)}
    )
    seeds = pages.filter(F.col("url").contains("utm_source=feed"))
    seen = crawl(pages, links, seeds, I.blocklist(spark), max_depth=1, stay_in_domain=False)
    return visit_rank(seen).select("norm_url", "round", "visit_rank")


# --- streams ------------------------------------------------------------------------------------


def _stream_pages(spark, sf) -> DataFrame:
    """The page table as a stream, with the media markup and a fetch time."""
    raw = St.table_stream(spark, sf, "pages", "page_id bigint, url string, html string")
    marked = I.project(raw, I.PAGES_MEDIA)
    return marked.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")))


def _stream_fetches(spark, sf) -> DataFrame:
    schema = I.table(spark, sf, "events").schema
    raw = St.table_stream(spark, sf, "events", schema)
    return H.outcomes(St.event_time(I.project(raw, I.FETCH_LOG)))


def _run_to_table(spark, df, name, mode="append") -> DataFrame:
    base = scratch(spark, name)
    if mode == "append":
        St.run_available(df, f"{base}/checkpoint", path=f"{base}/out")
        return spark.read.parquet(f"{base}/out")

    def write(batch, _):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    St.run_available(df, f"{base}/checkpoint", mode, batch=write)
    return spark.read.parquet(f"{base}/out")


@query("t01_stream_media")
def _(spark, sf):
    media = St.page_media(_stream_pages(spark, sf))
    return _run_to_table(spark, media, "t01").select("page_id", "media_type", "url", "source")


@query("t02_stream_distinct_media")
def _(spark, sf):
    """First sightings among all media that the extractors find."""
    media = St.page_media(_stream_pages(spark, sf))
    seen = media.select(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("fetched_at"), "url")
    return _run_to_table(spark, St.distinct_media(seen, "fetched_at", "365 days"), "t02").select("norm_url")


@query("t03_stream_health")
def _(spark, sf):
    base = scratch(spark, "t03")
    stream = St.HealthStream(spark, f"{base}/state", dt.timedelta(days=3650))
    stream.run(_stream_fetches(spark, sf), f"{base}/checkpoint")
    last = stream.latest()
    return last.select("host", "failures", "total", F.date_format("quarantined_at", "yyyy-MM-dd HH:mm:ss").alias("quarantined_at"))


@query("t04_stream_reputation")
def _(spark, sf):
    """Update mode: a batch writes the hosts it has changed, and the last of them counts."""
    base = scratch(spark, "t04")

    def write(batch, n):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    St.run_available(St.host_media(St.page_media(_stream_pages(spark, sf))), f"{base}/checkpoint", "update", batch=write)
    return spark.read.parquet(f"{base}/out").groupBy("host").agg(F.max_by("host_score", "batch").alias("host_score"))


@query("t05_stream_completion")
def _(spark, sf):
    """A run that ends by itself when nothing is left to read."""
    pages = _stream_pages(spark, sf).select("page_id", F.length("html").cast("bigint").alias("n_chars"))
    return _run_to_table(spark, pages, "t05")


@query("t05_stream_idle_end")
def _(spark, sf):
    """Media per page of a stream that waits for files: pages that come while it runs are taken in, and it ends once it is idle."""
    base = scratch(spark, "t05")
    arriving = media_pages(spark, sf)
    arriving.filter("page_id % 2 = 0").write.parquet(f"{base}/in")
    pages = spark.readStream.schema(arriving.schema).parquet(f"{base}/in")

    def more(batches: int) -> None:
        if batches == 1:
            arriving.filter("page_id % 2 = 1").write.mode("append").parquet(f"{base}/in")

    St.run_until_idle(St.page_media(pages), f"{base}/checkpoint", f"{base}/out", idle=2.0, after_batch=more)
    return spark.read.parquet(f"{base}/out").select("page_id", "media_type", "url", "source")


@query("t06_stream_restart")
def _(spark, sf):
    """Two runs on one checkpoint, between which pages arrive: the second goes on and repeats nothing."""
    base = scratch(spark, "t06")
    arriving = I.pages(spark, sf).select("page_id", "url")
    for part in range(2):
        arriving.filter(F.col("page_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        pages = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        St.run_available(pages.select("page_id", U.normalize_url("url").alias("norm_url")), f"{base}/checkpoint", path=f"{base}/out")
    return spark.read.parquet(f"{base}/out")


@query("t07_stream_progress")
def _(spark, sf):
    windows = St.progress_windows(_stream_fetches(spark, sf), "1 day", "1 hour")
    out = _run_to_table(spark, windows, "t07", "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "n_ok")
