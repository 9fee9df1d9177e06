"""The same queries as plain SQL for a second engine to check results against.

The SQL is written on its own: it shares the fixed word lists and the derived
inputs with the Spark code, not its expressions.
"""

from __future__ import annotations

import re

from mediaweave import constants as K
from mediaweave.plans import inputs as I

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\-", "-") for w in items) + ")"


def has(c: str, items) -> str:
    return f"regexp_matches({c}, {q(words(items))})"


def ends(c: str, items) -> str:
    return f"regexp_matches({c}, {q(words(items) + '$')})"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


_S = q(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?")


def scheme(c):
    return f"lower(regexp_extract({c}, {_S}, 1))"


def host(c):
    return f"regexp_extract({c}, {_S}, 2)"


def path(c):
    return f"regexp_replace(regexp_extract({c}, {_S}, 3), ';[^/]*$', '')"


def query_of(c):
    return f"regexp_extract({c}, {_S}, 4)"


def fragment(c):
    return f"regexp_extract({c}, {_S}, 5)"


def origin(c):
    return f"regexp_extract({c}, '^(https?://[^/?#]+)', 1)"


def norm(c):
    p, qs = path(c), query_of(c)
    return (
        f"({scheme(c)} || '://' || lower({host(c)}) || CASE WHEN length({p}) > 1 AND {p} LIKE '%/' THEN left({p}, -1)"
        f" ELSE {p} END || CASE WHEN {qs} <> '' THEN '?' || {qs} ELSE '' END)"
    )


def simple_join(base, ref):
    """Absolute form of a root-relative or absolute reference."""
    return f"CASE WHEN {ref} LIKE 'http%' THEN {ref} ELSE {origin(base)} || {ref} END"


def base2(h):
    return f"array_to_string(string_split({h}, '.')[-2:], '.')"


def segments(c):
    return f"list_filter(string_split(lower({path(c)}), '/'), lambda s: s <> '')"


def list_of(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


PM = f"pm AS ({I.as_sql(I.PAGES_MEDIA, 'pages')})"
HOSTS = "hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)"
_REF_RX = q(r"""(?:href|src|content|poster|data-full|data-src)="([^"]+)\"""")
CORPUS = f"""{PM},
refs AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, {_REF_RX}, 1)) AS ref FROM pm),
corpus AS (SELECT DISTINCT page_id, base, {simple_join('base', 'ref')} AS url FROM refs
           UNION SELECT page_id, url, url FROM pm),
urls AS (SELECT DISTINCT url FROM corpus),
pairs AS (SELECT DISTINCT base, url FROM corpus)"""


def url_oracle(name: str, pair: bool = False, **columns: str):
    keys = "base, url" if pair else "url"
    cols = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    ORACLE[name] = f"WITH {CORPUS} SELECT {keys}, {cols} FROM {'pairs' if pair else 'urls'}"


# --- URL tests as expressions ----------------------------------------------------

_SITE = r"^https?://[a-zA-Z0-9\-.]+\.[a-zA-Z]{2,3}(/\S*)\."
_FILES = K.IMAGE_EXTENSIONS + K.VIDEO_EXTENSIONS + K.AUDIO_EXTENSIONS
_STREAM = r"^https?://[^\s]+\.(m3u8|mpd)(\?[^\s]*)?|^https?://[^\s]+/playlist\.m3u8|^https?://[^\s]+/manifest\.mpd"
_VIDEO = _SITE + r"(mp4|webm|ogg|mov|avi|wmv|flv|mkv|m4v|ts|m3u8)"


def is_image(c):
    low = f"lower({c})"
    return f"({ends(path(low), K.IMAGE_EXTENSIONS)} OR {rx(low, _SITE + r'(jpg|jpeg|gif|png|webp|avif)')})"


def is_trash(c):
    return ends(path(f"lower({c})"), K.TRASH_EXTENSIONS)


def is_media(c):
    low = f"lower({c})"
    return f"""CASE WHEN {ends(path(low), _FILES)} THEN true
      WHEN {has(low, K.FULLSIZE_WORDS)} AND {has(low, _FILES)} THEN true
      WHEN {ends(low, K.WEBPAGE_EXTENSIONS + K.SCRIPT_EXTENSIONS)} THEN false
      ELSE {rx(low, _SITE + r'(jpg|jpeg|gif|png|webp|avif|svg|tiff)')} OR {rx(low, _VIDEO)} OR {rx(low, _STREAM)}
        OR {has(low, K.VIDEO_PLATFORM_INDICATORS)}
        OR {rx(low, words(_FILES + K.STREAM_EXTENSIONS + K.DOCUMENT_EXTENSIONS) + '([?&]|$)')}
        OR {has(host(low), K.CDN_MEDIA_HOSTS)} OR {has(path(low), K.MEDIA_PATHS)}
        OR {rx(query_of(low), words(K.MEDIA_PARAMS) + '(_id)?=')} END"""


def is_video(c):
    low = f"lower({c})"
    names = "|".join(K.VIDEO_NAME_PATTERNS)
    return f"""({ends(path(low), K.VIDEO_URL_EXTENSIONS)} OR {has(host(low), K.VIDEO_HOSTS)}
      OR {has(path(low), K.VIDEO_PATHS)} OR {rx(query_of(low), words(K.VIDEO_PARAMS) + '=')}
      OR {rx(low, names)} OR {rx(low, _VIDEO)} OR {rx(low, _STREAM)})"""


def is_webpage(c):
    low = f"lower({c})"
    return f"""CASE WHEN {is_media(c)} THEN false
      WHEN {ends(low, K.NOT_A_PAGE_EXTENSIONS)} THEN false
      WHEN {has(low, K.FULLSIZE_PAGE_WORDS)} AND {has(low, K.NOT_A_PAGE_EXTENSIONS)} THEN false
      WHEN {ends(low, K.WEBPAGE_EXTENSIONS)} THEN true
      WHEN {rx(low, '|'.join(K.CMS_PATTERNS))} THEN true
      WHEN {query_of(low)} <> '' THEN NOT {ends(path(low), K.NOT_A_PAGE_EXTENSIONS)} ELSE false END"""


def should_skip(c, extra):
    low = f"lower({c})"
    skip = K.SKIP_SEGMENTS + [w for w in extra if len(w) >= 3]
    return f"""({ends(path(low), K.SKIP_CRAWL_EXTENSIONS)} OR list_has_any({segments(c)}, {list_of(skip)})
      OR {has(low, K.AD_HOSTS)})"""


def is_cdn(c, kind):
    return f"regexp_matches({c}, {q('|'.join(K.CDN_PATTERNS[kind]))}, 'i')"


def platform(c):
    low = f"lower({c})"
    arms = "".join(f" WHEN {rx(host(low), '|'.join(p))} THEN {q(n)}" for n, p in K.VIDEO_PLATFORMS.items())
    return f"CASE WHEN {has(path(low), K.DIRECT_VIDEO_EXTENSIONS)} THEN 'direct-video'{arms} END"


def media_kind(c):
    low = f"lower({c})"
    return f"""CASE WHEN {ends(path(low), K.IMAGE_EXTENSIONS)} THEN 'image'
      WHEN {ends(path(low), K.VIDEO_EXTENSIONS)} THEN 'video' WHEN {ends(path(low), K.AUDIO_EXTENSIONS)} THEN 'audio'
      WHEN {has(low, K.VIDEO_PLATFORM_INDICATORS)} THEN 'video' ELSE 'file' END"""


def json_endpoint(c):
    low = f"lower({c})"
    p, qs = path(low), query_of(low)
    return f"""({p} LIKE '%/api/%' OR {p} LIKE '%/json/%' OR {p} LIKE '%.json' OR {qs} LIKE '%format=json%'
      OR {qs} LIKE '%output=json%' OR {qs} LIKE '%callback=%')"""


def looks_like_url(c):
    return f"""({c} LIKE 'http://%' OR {c} LIKE 'https://%' OR {c} LIKE '/%' OR {c} LIKE '%./%'
      OR {rx(c, r'^[\pL\pN\pM_\-\.]+\.[a-zA-Z]{2,}(/[\pL\pN\pM_\-\./\?\&\=\#\%]*)?$')})"""


def whole(c):
    return f"CASE WHEN regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(trim({c}) AS BIGINT) END"


def is_ad(url, width="NULL", height="NULL", texts=()):
    w, h = whole(f"{width}::VARCHAR"), whole(f"{height}::VARCHAR")
    shape = f"({w} <= 5 AND {h} <= 5) OR {w} >= 3 * {h} OR ({h} >= 5 * {w} AND {w} < 300)"
    wording = " OR ".join(f"coalesce({has(f'lower({t})', K.AD_WORDS)}, false)" for t in [url, *texts])
    return f"(coalesce({shape}, false) OR {wording})"


def significant(url, width="NULL", height="NULL", texts=()):
    w = whole(f"coalesce({width}::VARCHAR, '1000')")
    h = whole(f"coalesce({height}::VARCHAR, '1000')")
    return f"""(NOT {is_trash(url)} AND NOT {is_ad(url, width, height, texts)} AND NOT {has(f'lower({url})', K.NOISE_WORDS)}
      AND NOT coalesce({w} IS NOT NULL AND {h} IS NOT NULL AND ({w} < 100 OR {h} < 100), false))"""


def is_junk(c):
    return f"regexp_matches({c}, {q('|'.join(K.BROWSER_JUNK_PATTERNS))}, 'i')"


def likely_content(c):
    low = f"lower({c})"
    p = path(low)
    dates = r"/(19|20)\d{2}/(0[1-9]|1[0-2])/([0-2][0-9]|3[01])|/(0[1-9]|1[0-2])/([0-2][0-9]|3[01])/(19|20)\d{2}"
    return f"""({has(p, K.CONTENT_WORDS)} OR {has(query_of(low), K.CONTENT_WORDS)} OR {has(fragment(low), K.CONTENT_WORDS)}
      OR {rx(p, '/[0-9]+')} OR {rx(p, dates)})"""


def homepage(c):
    p, h = path(c), host(c)
    labels = f"string_split({h}, '.')"
    return f"""(list_contains({list_of(K.HOME_PATHS)}, lower({p})) OR ({p} IN ('', '/') AND
      ((len({labels}) <= 3 AND ({labels}[1] = 'www' OR len({labels}) = 2)) OR {query_of(c)} <> '')))"""


def nav_words(c):
    low = f"lower({c})"
    return "(" + " + ".join(
        f"(contains({path(low)}, {q(w)}) OR contains({query_of(low)}, {q(w)}))::INTEGER" for w in K.NAV_WORDS
    ) + ")"


def related(url, start):
    uh, sh = f"lower({host(url)})", f"lower({host(start)})"
    up, sp = f"trim(lower({path(url)}), '/')", f"trim(lower({path(start)}), '/')"
    us, ss = segments(url), segments(start)
    ident = r"^(.*?)/[0-9]+(/|$)"
    both = " AND ".join(has(x, K.CONTENT_SECTIONS) for x in (up, sp))
    return f"""CASE WHEN {uh} <> {sh} AND ends_with({sh}, '.' || {uh}) THEN false
      WHEN {uh} <> {sh} AND {base2(uh)} <> {base2(sh)} THEN false
      WHEN {sp} = '' THEN length({up}) > 0
      WHEN {up} = {sp} OR starts_with({up}, {sp} || '/') THEN true
      WHEN len({us}) > 0 AND {us}[1] = {ss}[1] THEN true
      WHEN {rx(up, '/[0-9]+(/|$)')} AND {rx(sp, '/[0-9]+(/|$)')}
        AND regexp_extract({up}, {q(ident)}, 1) = regexp_extract({sp}, {q(ident)}, 1) THEN true
      WHEN {both} THEN true
      ELSE len({ss}) <= 1 AND len({us}) <= 2 END"""


def common_prefix(a, b):
    x, y = segments(a), segments(b)
    return (
        f"list_max(list_filter(range(0, least(len({x}), len({y})) + 1), lambda i: ({x})[1:i] = ({y})[1:i]))::INTEGER"
    )


def safe_name(c):
    s = f"regexp_replace({c}, {q(chr(91) + '<>:' + chr(34) + '/' + chr(92) * 2 + '|?*' + chr(92) + 'x00-' + chr(92) + 'x1f]+')}, '_', 'g')"
    s = f"regexp_replace({s}, '\\s+', '_', 'g')"
    s = f"trim(regexp_replace({s}, '__+', '_', 'g'), '_')"
    split = q(r"^(\.*[^.].*)(\.[^.]*)$")
    name = f"CASE WHEN regexp_matches({s}, {split}) THEN regexp_extract({s}, {split}, 1) ELSE {s} END"
    ext = f"left(CASE WHEN regexp_matches({s}, {split}) THEN regexp_extract({s}, {split}, 2) ELSE '' END, 7)"
    return f"""CASE WHEN ({name}) = '' THEN left(md5({c}), 10) || CASE WHEN {ext} = '' THEN '.jpg' ELSE {ext} END
      ELSE left({name}, 200) || {ext} END"""


def file_name(url, kind):
    base = f"string_split(trim({path(url)}, '/'), '/')[-1]"
    ext = f"CASE WHEN {kind} = 'image' THEN '.jpg' ELSE '.mp4' END"
    return safe_name(
        f"(CASE WHEN contains({base}, '.') THEN {base} WHEN {base} <> '' THEN {base} || {ext}"
        f" ELSE left(md5({url}), 10) || {ext} END)"
    )


def folder(c):
    bad = q(r'[<>:"/\\|?*]')
    parts = f"list_filter(string_split({path(c)}, '/'), lambda s: s <> '')[1:2]"
    safe = f"list_transform({parts}, lambda s: left(regexp_replace(s, {bad}, '_', 'g'), 50))"
    return f"array_to_string(list_prepend(regexp_replace({host(c)}, {bad}, '_', 'g'), {safe}), '/')"


def base_name(c):
    return f"string_split(string_split({c}, '?')[1], '/')[-1]"


# --- first query, sources and sinks ------------------------------------------------

ORACLE["q00_top_link_hosts"] = f"""
WITH refs AS (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) AS ref FROM pages),
links AS (SELECT DISTINCT {norm(f"({simple_join('url', 'ref')})")} AS link FROM refs)
SELECT {host('link')} AS host, count(*) AS n_links FROM links GROUP BY 1 ORDER BY n_links DESC, host LIMIT 10"""

ORACLE["s01_read_pages"] = """
SELECT page_id, url, length(html)::BIGINT AS n_chars, 'SUCCESS' AS error_status FROM pages"""

ORACLE["s02_decode_bytes"] = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-8-SIG' ELSE 'UTF-16' END AS charset,
  md5(html) AS digest FROM pages"""

JP = f"jp AS ({I.as_sql(I.JSON_PAYLOADS, 'events')})"
ORACLE["s03_read_json_payloads"] = f"""
WITH {JP}, t AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN left(body, -1) WHEN 2 THEN 'x' || body ELSE body END AS body FROM jp)
SELECT doc_id, json_valid(body) AS parsed, CASE WHEN json_valid(body) THEN body ->> '$.next' END AS next FROM t"""

ORACLE["s04_read_blocklist"] = f"WITH {HOSTS} SELECT host FROM hosts WHERE length(host) % 3 <> 0"

ORACLE["s05_read_site_patterns"] = f"""
WITH {HOSTS}
SELECT host AS site, true AS enabled, CASE WHEN length(host) > 20 THEN '' ELSE host END AS domains,
  CASE WHEN length(host) > 20 THEN '/en/' ELSE '' END AS url_patterns,
  CASE WHEN length(host) > 20 THEN '/s/>/l/' ELSE '/t/>/f/' END AS replacements
FROM hosts WHERE length(host) > 20 OR length(host) % 4 <> 0"""

ORACLE["s06_read_rules"] = f"""
WITH {HOSTS}
SELECT 1 AS ord, host AS name, '^(www\\.)?' || replace(host, '.', '\\.') || '/(.+)' AS link, '^(.+)/t/(.+)' AS img,
  '$1/f/$2' AS "to", 'src=(a)|src=(b)' AS res, lower(host) AS domain FROM hosts
UNION ALL
SELECT 2, 'g', CASE WHEN length(host) % 2 = 0 THEN 'x' END, 'thumb-(.+)', '$1',
  CASE WHEN length(host) % 2 = 0 THEN 'c(d)' END, NULL FROM hosts"""

_RULE_HOST = q(r"(?i)\^?\s*\(?\s*(?:www\.)?([a-z0-9-]+(?:\\[.][a-z0-9-]+)+)")
ORACLE["s07_rule_domain"] = f"""
WITH {HOSTS}, e AS (SELECT host, replace(host, '.', '\\.') AS x FROM hosts),
f AS (SELECT host, 0 AS form, '^(' || x || '/x)' AS r FROM e UNION ALL SELECT host, 1, '^www\\.' || upper(x) || '/' FROM e
  UNION ALL SELECT host, 2, '/img/' || host FROM e UNION ALL SELECT host, 3, x FROM e)
SELECT host, form, nullif(lower(replace(regexp_extract(r, {_RULE_HOST}, 1), '\\.', '.')), '') AS domain FROM f"""

ORACLE["s08_res_patterns"] = f"""
WITH {HOSTS}
SELECT host AS name, '^(www\\.)?' || replace(host, '.', '\\.') || '/(.+)' AS link, 'src=(a)|src=(b)' AS res FROM hosts
UNION ALL SELECT 'g', 'x', 'c(d)' FROM hosts WHERE length(host) % 2 = 0"""

_T0 = "TIMESTAMP '2024-01-01 00:00:00'"
TASKS = f"""t0 AS ({I.as_sql({**I.TASKS, 'page_id': 'page_id'}, 'pages')}),
tasks AS (SELECT *, {_T0} + to_seconds(page_id * 61) AS created_at,
  CASE WHEN status <> 'queued' THEN {_T0} + to_seconds(page_id * 61 + 30) END AS started_at,
  CASE WHEN status IN ('completed', 'stopped', 'failed') THEN {_T0} + to_seconds(page_id * 61 + 90) END AS completed_at,
  status IN ('completed', 'stopped', 'failed') AS finished FROM t0)"""


def stamp(c):
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"


ORACLE["s09_export_tasks_csv"] = f"""
WITH {TASKS}
SELECT row_number() OVER (ORDER BY finished, created_at, id) AS position, id, url, status, downloaded,
  images + videos AS found, {stamp('created_at')} AS created, {stamp('started_at')} AS started,
  {stamp('completed_at')} AS completed, download_path AS path FROM tasks"""

IMPORTED = f"""{TASKS}, imported AS (
SELECT CASE WHEN page_id % 7 = 3 THEN '' ELSE url END AS url,
  CASE WHEN page_id % 7 = 3 THEN 'skipped' WHEN page_id % 4 - 1 > 0 THEN 'restored' ELSE 'queued' END AS outcome,
  CASE WHEN page_id % 7 = 3 THEN NULL WHEN page_id % 4 - 1 > 0 THEN download_path
    ELSE replace(string_split(url, '/')[3], '.', '_') || '_20240506_070809' END AS download_path,
  CASE WHEN page_id % 7 = 3 THEN NULL WHEN page_id % 4 - 1 > 0 THEN 'completed' ELSE 'queued' END AS status
FROM tasks)"""
ORACLE["s10_import_tasks_csv"] = f"WITH {IMPORTED} SELECT * FROM imported"

ORACLE["s11_tasks_json_round_trip"] = f"""
WITH {TASKS} SELECT id, url, one_shot, CASE WHEN status = 'running' THEN 'paused' ELSE status END AS status,
  images AS images_found, {stamp('created_at')} AS created_at FROM tasks"""

ORACLE["s12_posted_items"] = f"""
WITH p AS (SELECT page_id, url, page_id % 2 = 0 AS os FROM pages),
items AS (
  SELECT page_id, 0 AS k, os, url AS raw, url AS page, 'video' AS kind FROM p
  UNION ALL SELECT page_id, 1, os, 'https://cdn.example.com/p/' || page_id || '.jpg?x=1', url, 'image' FROM p WHERE os
  UNION ALL SELECT page_id, CASE WHEN os THEN 2 ELSE 1 END, os, 'https://h.example.com/d/' || page_id || '/', url, 'image' FROM p),
n AS (SELECT *, CASE WHEN os THEN {norm('raw')} ELSE raw END AS u FROM items)
SELECT page_id AS post_id, k AS pos, os AS one_shot, u AS url, CASE WHEN os THEN page END AS source_url,
  CASE WHEN os THEN kind END AS media_type,
  CASE WHEN os THEN CASE WHEN contains({base_name('u')}, '.') THEN {base_name('u')} ELSE 'media_' || k || '.jpg' END END AS filename
FROM n"""

ORACLE["s13_state_round_trip"] = f"""
SELECT url, 1 AS depth, (page_id / 8.0)::DOUBLE AS priority, {norm('url')} AS norm_url FROM pages"""


def _clamped(key):
    low, high, default = K.SETTING_RANGES[key]
    number = whole(key)
    return (
        f"CASE WHEN {key} IS NULL THEN NULL WHEN {number} IS NULL THEN '{default}'"
        f" ELSE greatest({low}, least({high}, {number}))::VARCHAR END AS {key}"
    )


ORACLE["s14_clamp_settings"] = f"""
WITH s AS ({I.as_sql(I.SETTINGS, 'events')})
SELECT event_id, {_clamped('search_depth')}, {_clamped('timeout')}, {_clamped('page_limit')},
  replace(replace(user_agent, chr(13), ''), chr(10), '') AS user_agent, note FROM s"""

# --- URL functions -------------------------------------------------------------------

url_oracle(
    "u01_url_parts", scheme=scheme("url"), netloc=host("url"), path=path("url"), query=query_of("url"), fragment=fragment("url")
)
url_oracle(
    "u02_is_valid_url",
    valid=f"{scheme('url')} IN ('http', 'https') AND {host('url')} <> ''",
    bare="false",
)
url_oracle("u03_normalize_url", norm=norm("url"))
url_oracle("u04_get_domain", domain=host("url"))
url_oracle(
    "u05_base_domain", True, base_domain=base2(host("url")), same=f"{base2(host('url'))} = {base2(host('base'))}"
)


def _dotless(p):
    for _ in range(3):
        p = f"regexp_replace({p}, '/\\.(/|$)', '/', 'g')"
    for _ in range(6):
        p = f"regexp_replace({p}, '/[^/]+/\\.\\.(/|$)', '/')"
    return f"regexp_replace({p}, '^(/\\.\\.)+(/|$)', '/')"


_REFS = ", ".join(f"({q(r)})" for r in I.REFS)
ORACLE["u06_url_join"] = f"""
WITH r AS (SELECT page_id, url, ref, regexp_extract(ref, '^[^?#]*') AS rp, substr(ref, length(regexp_extract(ref, '^[^?#]*')) + 1) AS tail
  FROM pages, (VALUES {_REFS}) AS v(ref)),
m AS (SELECT *, CASE WHEN rp LIKE '/%' THEN rp ELSE coalesce(nullif(regexp_extract({path('url')}, '^(.*/)', 1), ''), '/') || rp END AS merged FROM r),
-- a climb above the root needs its parent steps removed innermost first
d AS (SELECT *, {_dotless('merged')} AS done FROM m)
SELECT page_id, ref, CASE WHEN ref = '' THEN url WHEN regexp_matches(ref, '^[a-z]+:') THEN ref
  WHEN ref LIKE '//%' THEN {scheme('url')} || ':' || ref WHEN ref LIKE '#%' THEN regexp_extract(url, '^[^#]*') || ref
  WHEN ref LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || ref ELSE {origin('url')} || done || tail END AS joined
FROM d"""

url_oracle("u07_path_segments", segments=f"array_to_string({segments('url')}, '|')")
url_oracle("u08_is_image_url", hit=is_image("url"))
url_oracle("u09_is_trash_media", hit=is_trash("url"))
url_oracle("u10_is_media_url", hit=is_media("url"))
url_oracle("u11_is_video_url", hit=is_video("url"))
url_oracle("u12_is_webpage_url", hit=is_webpage("url"))
url_oracle("u13_should_skip_crawl_url", hit=should_skip("url", K.STOP_WORDS + ["en", "moved"]))
url_oracle("u14_is_cdn_url", img=is_cdn("url", "img"), video=is_cdn("url", "video"))
url_oracle("u15_video_platform", platform=platform("url"))
url_oracle("u16_guess_media_type", kind=media_kind("url"))
url_oracle(
    "u17_is_json_endpoint", hit=json_endpoint("url"), api=json_endpoint("(url || '/api/x')"),
    param=json_endpoint("(url || '&format=json')"),
)
url_oracle(
    "u18_looks_like_url",
    hit=looks_like_url("url"),
    bare=looks_like_url("regexp_replace(url, '^https?://', '')"),
    last=looks_like_url(base_name("url")),
)
ORACLE["u19_is_media_key"] = f"""
WITH {PM}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+')) AS key FROM pm)
SELECT key, {has('lower(key)', K.MEDIA_KEY_WORDS)} AS hit FROM w"""

IMAGE_URLS = (
    f"image_urls AS (SELECT page_id, url AS page_url, unnest([{', '.join(I.IMAGE_FORMS)}]) AS url FROM pages)"
)
_ATTRS = ", ".join(f"{e} AS {n}" for n, e in I.IMAGE_ATTRS.items())
ORACLE["u20_is_banner_or_ad"] = f"""
WITH {IMAGE_URLS}, a AS (SELECT page_id, url, {_ATTRS} FROM image_urls)
SELECT *, {is_ad('url', 'width', 'height', ['css', 'dom_id', 'alt'])} AS ad FROM a"""
ORACLE["u21_is_significant"] = f"""
WITH {IMAGE_URLS}, a AS (SELECT page_id, url, {_ATTRS} FROM image_urls)
SELECT page_id, url, {significant('url', 'width', 'height', ['css', 'dom_id', 'alt'])} AS significant FROM a"""
url_oracle("u22_is_junk_url", hit=is_junk("url"))
url_oracle("u23_is_likely_content", hit=likely_content("url"))
_ROOT = "regexp_replace(url, '^(https?://[^/]+/?).*?(\\?.*)?$', '\\1\\2')"
url_oracle("u24_is_homepage", home=homepage("url"), root=homepage(_ROOT), nav=nav_words("url"))
url_oracle("u25_is_related", True, related=related("url", "base"), back=related("base", "url"))
url_oracle("u26_common_prefix_len", True, n=common_prefix("base", "url"))
url_oracle(
    "u27_filename_from_url", image=file_name("url", "'image'"), video=file_name("url", "'video'"),
    root=file_name(origin("url"), "'image'"),
)
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
ORACLE["u28_sanitize_filename"] = f"""
WITH t AS (SELECT page_id, url, {_TITLE} AS title FROM pages)
SELECT page_id, {safe_name('title')} AS from_title, {safe_name('url')} AS from_url, {safe_name("'??.jpg'")} AS hashed,
  {safe_name('repeat(title, 9)')} AS long_name FROM t"""
url_oracle("u29_target_dir", dir=folder("url"))
url_oracle("u30_file_basename", base_name=base_name("url"))
ORACLE["u31_task_folder"] = f"""
WITH {TASKS} SELECT id, replace(string_split(url, '/')[3], '.', '_') || strftime(created_at, '_%Y%m%d_%H%M%S') AS folder,
  'unknown' || strftime(created_at, '_%Y%m%d_%H%M%S') AS other FROM tasks"""
ORACLE["u32_referer_for"] = f"""
WITH p AS (SELECT page_id, ['auto', 'origin', 'none'][page_id % 3 + 1] AS policy, url FROM pages)
SELECT page_id, policy, CASE policy WHEN 'auto' THEN url WHEN 'origin' THEN {origin('url')} END AS referer FROM p"""


# --- page markup ---------------------------------------------------------------------


def nodes_of(pages: str, name: str = "n") -> str:
    """CTEs with one row per start tag, in document order, and the markup before it."""
    tags = f"regexp_extract_all(html, '<[a-zA-Z][^>]*>|</[a-zA-Z][^>]*>')"
    return f"""{name}_tok AS (SELECT page_id, url, unnest({tags}) AS t, generate_subscripts({tags}, 1) AS i FROM {pages}),
{name}_all AS (SELECT *, lag(t) OVER (PARTITION BY page_id ORDER BY i) AS before FROM {name}_tok),
{name} AS (SELECT page_id, url, t, before, regexp_extract(t, '^<([a-zA-Z0-9]+)', 1) AS tag,
  (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS node_id FROM {name}_all WHERE t NOT LIKE '</%')"""


def attr(name, t="t"):
    has_it = f"regexp_matches({t}, ' {name}=\"')"
    return f"(CASE WHEN {has_it} THEN replace(regexp_extract({t}, ' {name}=\"([^\"]*)\"', 1), '&quot;', '\"') END)"


NODES = f"{PM}, {nodes_of('pm')}"
ORACLE["h01_nodes"] = f"""
WITH {NODES} SELECT page_id, node_id, tag, {attr('href')} AS href, {attr('src')} AS src, {attr('class')} AS css,
  len(regexp_extract_all(t, ' [a-z-]+="'))::INTEGER AS n_attrs FROM n"""
ORACLE["h01_node_counts"] = f"""
WITH {NODES} SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM n GROUP BY tag"""

SRCSETS = f"s AS ({I.as_sql({'page_id': 'page_id', 'srcset': I.SRCSET}, 'pages')})"
_SRC_ITEMS = f"""{SRCSETS},
i0 AS (SELECT page_id, unnest(list_filter(list_transform(string_split(srcset, ','), lambda x: trim(x)), lambda x: x <> '')) AS item,
  generate_subscripts(list_filter(list_transform(string_split(srcset, ','), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS pos FROM s),
items AS (SELECT page_id, pos, regexp_extract(item, '^[^ ]+') AS u, regexp_extract(item, ' +([^ ]+)$', 1) AS d FROM i0),
c AS (SELECT *, CASE WHEN d LIKE '%w' THEN left(d, -1)::BIGINT WHEN d LIKE '%x' THEN trunc(left(d, -1)::DOUBLE * 1000)::BIGINT ELSE 0 END AS width,
  CASE WHEN d LIKE '%w' THEN left(d, -1)::DOUBLE WHEN d LIKE '%x' THEN coalesce(nullif(left(d, -1)::DOUBLE, 0), 1) * 10000 ELSE 1 END AS score FROM items)"""
ORACLE["h02_parse_srcset"] = f"WITH {_SRC_ITEMS} SELECT page_id, pos::INTEGER AS pos, u AS url, width FROM c"
ORACLE["h03_largest_srcset"] = f"""
WITH {_SRC_ITEMS} SELECT page_id, first(u ORDER BY width DESC, pos) FILTER (d LIKE '%w') AS by_width,
  first(u ORDER BY score DESC, pos) AS by_browser FROM c GROUP BY page_id"""

_HIDES = "(regexp_matches(coalesce({t}, ''), 'class=\"[^\"]*d-none') OR coalesce({t}, '') LIKE '%display:none%')"
ORACLE["h04_visible"] = f"""
WITH {NODES} SELECT page_id, node_id, tag, NOT {_HIDES.format(t='t')} AND NOT (before NOT LIKE '</%' AND {_HIDES.format(t='before')}) AS visible
FROM n WHERE tag IN ('a', 'img', 'div', 'p')"""

_IMG = f"{NODES}, img AS (SELECT page_id, url AS page_url, node_id, t, {attr('src')} AS src, {attr('data-full')} AS df, {attr('srcset')} AS ss FROM n WHERE tag = 'img')"
_BEST = f"""{_IMG}, o AS (
  SELECT page_id, node_id, 0 AS grp, 0 AS pos, src AS u, 0 AS rank, 'src' AS source FROM img
  UNION ALL SELECT page_id, node_id, 0, 1, df, 100, 'data-full' FROM img WHERE df IS NOT NULL
  UNION ALL SELECT page_id, node_id, 1, x.k, regexp_extract(trim(x.item), '^[^ ]+'),
    CASE WHEN x.item LIKE '%w' THEN regexp_extract(x.item, '([0-9]+)w$', 1)::INTEGER ELSE regexp_extract(x.item, '([0-9]+)x$', 1)::INTEGER * 1000 END, 'srcset'
    FROM (SELECT page_id, node_id, unnest(string_split(ss, ',')) AS item, generate_subscripts(string_split(ss, ','), 1) AS k FROM img WHERE ss IS NOT NULL) x
  UNION ALL SELECT page_id, node_id, 2, 0, src, 0, 'src' FROM img
  UNION ALL SELECT page_id, node_id, 2, 1, df, 999999, 'data-full' FROM img WHERE df IS NOT NULL)"""
ORACLE["h05_best_image"] = f"""
WITH {_BEST}, b AS (SELECT page_id, node_id, first(struct_pack(u := u, rank := rank, source := source) ORDER BY rank DESC, grp, pos) AS b FROM o GROUP BY ALL)
SELECT page_id, node_id, b.u AS url, b.rank::BIGINT AS rank, b.source AS source,
  {attr('width')}::BIGINT AS width, {attr('height')}::BIGINT AS height FROM b JOIN n USING (page_id, node_id)"""

# What each kind of inserted markup must yield: operator, media type, reference, source, test.
_I = "page_id::VARCHAR"
EXPECTED_ROWS = [
    (0, "h07", "image", f"'/pics/' || {_I} || '.jpg'", "src", "sig"),
    (1, "h07", "image", f"'/s/' || {_I} || '-d.jpg'", "srcset", "sig"),
    (2, "h07", "image", f"'/full/' || {_I} || '.jpg'", "data-full", "sig"),
    (2, "h16", "image", f"'/full/' || {_I} || '.jpg'", "data-direct-data-full", "sig"),
    (3, "h07", "image", f"'/t/' || {_I} || '.jpg'", "src", "sig"),
    (3, "h07", "image", f"'/large/' || {_I} || '.jpg'", "parent-link", "sig"),
    (4, "h07", "image", f"'/t/' || {_I} || '.jpg'", "src", "sig"),
    (4, "h07", "image", f"'/gallery/' || {_I}", "fullsize-link", "sig"),
    (6, "h06", "image", f"'/p/' || {_I} || '.webp'", "srcset", "sig"),
    (6, "h07", "image", f"'/p/' || {_I} || '.jpg'", "src", "sig"),
    (7, "h11", "video", f"'/v/' || {_I} || '.mp4'", None, "none"),
    (7, "h11", "video", f"'/v/' || {_I} || '.webm'", None, "none"),
    (8, "h12", "video", f"'https://player.vimeo.com/video/' || {_I}", "iframe", "none"),
    (9, "h14", "video", f"'https://m.example.net/v/' || {_I} || '.mp4'", "json-ld", "none"),
    (9, "h14", "image", f"'https://m.example.net/i/' || {_I} || '.jpg'", "json-ld", "none"),
    (9, "h15", "image", f"'https://m.example.net/i/' || {_I} || '.jpg'", "js-static-image_sources", "sig"),
    (9, "h15", "video", f"'https://m.example.net/v/' || {_I} || '.mp4'", "js-static-video_sources", "sig"),
    (10, "h08", "image", f"'/bg/' || {_I} || '.png'", "css", "sig"),
    (11, "h09", "image", f"'/fav/' || {_I} || '.png'", None, "none"),
    (11, "h10", "image", f"'/og/' || {_I} || '.jpg'", "meta", "sig"),
    (12, "h15", "image", f"'https://cdn.example.com/j/' || {_I} || '.png'", "js-static-image_sources", "sig"),
    (12, "h15", "video", f"'https://cdn.example.com/j/' || {_I} || '.mp4'", "js-static-video_sources", "sig"),
    (12, "h15", "video", f"'https://cdn.example.com/j/' || {_I} || '.mp4'", "js-static-video_sources", "sig"),
    (13, "h16", "video", f"'https://m.example.net/d/' || {_I} || '.mp4'", "data-json-data-item-u", "sig"),
    (13, "h16", "image", f"'/lazy/' || {_I} || '.jpg'", "data-direct-data-src", "sig"),
    (13, "h17", "image", f"'/lazy/' || {_I} || '.jpg'", "lazy-data-data-src", "sig"),
]
_STAGE = {"h06": 0, "h07": 1, "h08": 2, "h09": 3, "h10": 4, "h11": 5, "h12": 6, "h14": 8, "h15": 9, "h16": 10, "h17": 11}


def _expected() -> str:
    parts = []
    for n, (variant, op, kind, ref, source, test) in enumerate(EXPECTED_ROWS):
        src = "NULL" if source is None else q(source)
        parts.append(
            f"SELECT page_id, url AS page_url, {q(op)} AS op, {_STAGE[op]} AS stage, {n} AS k, {q(kind)} AS media_type, {ref} AS ref,"
            f" {src}::VARCHAR AS source, {q(test)} AS test FROM pages WHERE page_id % 16 = {variant}"
        )
    return f"""e0 AS ({' UNION ALL '.join(parts)}),
e1 AS (SELECT *, {simple_join('page_url', 'ref')} AS url FROM e0),
media AS (SELECT * FROM e1 WHERE test = 'none' OR {significant('url')})"""


MEDIA = _expected()


def media_oracle(name: str, op: str):
    ORACLE[name] = f"WITH {MEDIA} SELECT page_id, media_type, url, source FROM media WHERE op = {q(op)}"


ORACLE["h06_picture_images"] = f"""
WITH {MEDIA} SELECT page_id, url, source, '900' AS width, '(min-width:800px)' AS media FROM media WHERE op = 'h06'"""
ORACLE["h07_img_images"] = f"""
WITH {MEDIA} SELECT page_id, url, source, page_id % 16 = 4 AND source = 'src' AS transformed,
  CASE WHEN page_id % 16 = 4 AND source = 'src' THEN '/t/' || page_id || '-300x200.jpg' END AS original_url FROM media WHERE op = 'h07'"""
ORACLE["h07_img_images_requoted_all"] = ORACLE["h07_img_images"]
ORACLE["h07_img_images_min_size"] = f"""
SELECT page_id, CASE WHEN page_id % 16 = 1 THEN regexp_replace(url, '-d[.]jpg$', '.jpg') ELSE url END AS url,
  CASE WHEN page_id % 16 = 1 THEN 'src' ELSE source END AS source, transformed, original_url FROM ({ORACLE['h07_img_images']})"""
_V4 = f"""SELECT page_id, {origin('url')} || '/gallery/' || page_id AS url, {origin('url')} || '/t/' || page_id || '.jpg' AS thumbnail_url, 15.0::DOUBLE AS priority
  FROM pages WHERE page_id % 16 = 4 AND {significant(f"({origin('url')} || '/t/' || page_id || '.jpg')")}
  UNION ALL SELECT page_id, {origin('url')} || '/post/' || page_id, {origin('url')} || '/t2/' || page_id || '.jpg', 15.0
  FROM pages WHERE page_id % 16 = 4"""
ORACLE["h07_img_links"] = _V4 + f"""
  UNION ALL SELECT page_id, {origin('url')} || '/gallery/' || page_id, NULL, NULL FROM pages WHERE false"""
for _name, _op in [
    ("h08_css_images", "h08"), ("h09_icon_images", "h09"), ("h10_meta_images", "h10"), ("h14_jsonld_media", "h14"),
    ("h15_js_media", "h15"), ("h16_data_attr_media", "h16"), ("h17_lazy_media", "h17"),
]:
    media_oracle(_name, _op)
ORACLE["h11_video_tags"] = f"""
WITH {MEDIA} SELECT page_id, url, {is_cdn('url', 'video')} AS is_cdn, '/v/' || page_id || '.jpg' AS poster,
  CASE WHEN url LIKE '%.webm' THEN 'video/webm' ELSE '' END AS kind FROM media WHERE op = 'h11'"""
ORACLE["h12_video_embeds"] = f"WITH {MEDIA} SELECT page_id, url, 'vimeo' AS platform FROM media WHERE op = 'h12'"
ORACLE["h13_meta_videos"] = f"""
WITH v AS (SELECT page_id, {origin('url')} || '/og/' || page_id || '.jpg' AS url FROM pages WHERE page_id % 16 = 11)
SELECT page_id, 'video' AS media_type, url, 'meta' AS source, {platform('url')} AS platform FROM v"""
ORACLE["h18_framework_media"] = f"""
WITH {NODES}, v AS (SELECT page_id, {origin('url')} || {attr('src')} AS u FROM n WHERE tag = 'img' AND regexp_matches(t, '^<img src="/'))
SELECT page_id, 'image' AS media_type, u AS url, 'framework-vue' AS source FROM v WHERE {is_media('u')} AND {significant('u')}"""

_ANCHOR_RX = q(r'<a (?:class="[^"]*" )?href="([^"]*)"[^>]*>(.*?)</a>')
ANCHORS = f"""{PM},
a0 AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {_ANCHOR_RX}, 1)) AS href,
  unnest(regexp_extract_all(html, {_ANCHOR_RX}, 2)) AS inner_html, generate_subscripts(regexp_extract_all(html, {_ANCHOR_RX}, 1), 1) AS i FROM pm),
anchors AS (SELECT page_id, page_url, i, {simple_join('page_url', 'href')} AS url,
  left(trim(regexp_replace(replace(inner_html, '&amp;', '&'), '<[^>]*>', '', 'g')), 100) AS text FROM a0 WHERE href <> ''),
canon AS (SELECT page_id, {origin('url')} || '/c/' || page_id AS url FROM pages WHERE page_id % 16 = 11)"""
_PLAIN_LINKS = """SELECT page_id, url, false AS from_image, 'a' AS element, arg_max(text, i) AS text, NULL::DOUBLE AS priority, NULL::VARCHAR AS thumbnail_url
FROM anchors GROUP BY page_id, url
UNION ALL SELECT page_id, url, false, 'canonical', NULL, 2.0, NULL FROM canon"""
ORACLE["h19_links"] = f"WITH {ANCHORS} {_PLAIN_LINKS}"
ORACLE["h19_links_hidden_too"] = ORACLE["h19_links_requoted"] = ORACLE["h19_links"]
ORACLE["h20_canonical_link"] = f"WITH {ANCHORS} SELECT page_id, url, 2.0::DOUBLE AS priority FROM canon"
LINKS = f"""{ANCHORS}, plain AS ({_PLAIN_LINKS}), image_links AS ({_V4}),
links AS (SELECT p.page_id, p.url, m.url IS NOT NULL AS from_image, CASE WHEN m.url IS NULL THEN p.element END AS element,
  CASE WHEN m.url IS NULL THEN p.text ELSE nullif(p.text, '') END AS text, coalesce(m.priority, p.priority) AS priority, m.thumbnail_url
  FROM plain p LEFT JOIN image_links m USING (page_id, url))"""

_REDIRECT = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(html, {q(p)}, 1, 'i'), '')" for p in K.JS_REDIRECT_PATTERNS
) + ")"
ORACLE["h21_js_redirect"] = f"""
WITH {PM}, r AS (SELECT page_id, url, {_REDIRECT} AS target FROM pm)
SELECT page_id, target, {norm(f"({simple_join('url', 'target')})")} AS dst FROM r WHERE target IS NOT NULL"""
ORACLE["h22_resolve_redirects"] = f"""
WITH RECURSIVE m AS (SELECT max(page_id) AS top FROM pages),
r AS (SELECT p.page_id, {norm('p.url')} AS src, CASE WHEN (p.page_id + 1) % 8 <> 0 AND p.page_id < top THEN {norm('t.url')} END AS dst
  FROM pages p CROSS JOIN m LEFT JOIN pages t ON t.page_id = p.page_id + 1),
hop AS (SELECT src, first(dst ORDER BY page_id) AS dst FROM r GROUP BY src),
walk AS (SELECT page_id, url, {norm('url')} AS here, 0 AS hops FROM pages
  UNION ALL SELECT page_id, url, dst, hops + 1 FROM walk JOIN hop ON src = here WHERE dst IS NOT NULL AND hops < 6)
SELECT page_id, url, arg_max(here, hops) AS final_url, max(hops)::INTEGER AS hops, max(hops) > 5 AS limit_exceeded FROM walk GROUP BY page_id, url"""

_GATE = f"""{ANCHORS}, g0 AS (SELECT a0.page_id, href, lower(trim(regexp_replace(replace(inner_html, '&amp;', '&'), '<[^>]*>', '', 'g'))) AS text,
  href = '/in/' || a0.page_id AND a0.page_id % 16 = 15 AS enter FROM a0 WHERE href <> ''),
g AS (SELECT page_id, href AS url, text, {has('text', K.GATEWAY_TEXTS)} AS tm, enter AS am,
  list_contains({list_of([t for t in K.GATEWAY_TEXTS if len(t) > 5])}, text) AS exact FROM g0)"""
ORACLE["h23_gateway_candidates"] = f"""
WITH {_GATE} SELECT page_id, url, 'GET' AS method, text,
  (CASE WHEN exact THEN 100 WHEN tm THEN 20 ELSE 0 END + CASE WHEN am THEN 10 ELSE 0 END)::INTEGER AS score
FROM g WHERE (tm OR am) AND NOT {has('text', K.GATEWAY_LEGAL_WORDS)} AND NOT {has('lower(url)', K.GATEWAY_LEGAL_WORDS)}"""

_SCAN_IMG = r"(?i)\.(jpe?g|png|gif|webp|bmp|tiff?|avif|heic)(\?|$)"
ORACLE["h24_scan_page"] = f"""
WITH {NODES}, raw AS (
  SELECT page_id, url AS page_url, node_id, 0 AS stage, 0 AS pos, {attr('src')} AS ref, 'image' AS kind, 'img' AS source, coalesce({attr('alt')}, '') AS alt FROM n WHERE tag = 'img'
  UNION ALL SELECT page_id, url, node_id, 0, 1, '/s/' || page_id || '-d.jpg', 'image', 'srcset', NULL FROM n WHERE tag = 'img' AND t LIKE '% srcset=%'
  UNION ALL SELECT page_id, url, node_id, 1, 0, {attr('href')}, 'image', 'a-link', NULL FROM n WHERE tag = 'a' AND regexp_matches({attr('href')}, {q(_SCAN_IMG)})
  UNION ALL SELECT page_id, url, node_id, 2, 0, {attr('src')}, 'video', CASE tag WHEN 'video' THEN 'video' ELSE 'source' END, NULL FROM n WHERE tag IN ('video', 'source') AND t LIKE '% src=%'
  UNION ALL SELECT page_id, url, node_id, 3, 0, regexp_extract({attr('srcset')}, '^[^ ]+'), 'image', 'picture', NULL FROM n WHERE tag = 'source' AND t LIKE '% srcset=%'
  UNION ALL SELECT page_id, url, node_id, 5, 0, {attr('content')}, 'image', 'meta', NULL FROM n WHERE tag = 'meta' AND t LIKE '%og:image%'),
f AS (SELECT *, {simple_join('page_url', 'ref')} AS url FROM raw WHERE ref <> '')
SELECT page_id, url, first(kind ORDER BY stage, node_id, pos) AS media_type, first(source ORDER BY stage, node_id, pos) AS source,
  first(alt ORDER BY stage, node_id, pos) AS alt FROM f WHERE NOT {is_junk('url')} GROUP BY page_id, url"""
ORACLE["h24_scan_links"] = f"""
WITH {ANCHORS} SELECT DISTINCT page_id, url FROM anchors WHERE url <> page_url AND
  (NOT regexp_matches(url, {q(_SCAN_IMG)}) OR page_id % 16 = 3 AND url LIKE '%/large/%')"""
_FULL_IMG = f"replace(html, '<img src=\"/', '<img src=\"' || {origin('url')} || '/')"
ORACLE["h25_img_src_regex"] = f"""
WITH {PM}, u AS (SELECT page_id, regexp_extract_all({_FULL_IMG}, '<img[^>]+src=["'']([^"'']+)["'']', 1) AS l FROM pm),
k AS (SELECT page_id, list_filter(l, lambda x: regexp_matches(x, '(?i)^http.*\\.(jpe?g|webp|avif|heic|bmp|tiff?)$')) AS l FROM u)
SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS img_url FROM k"""

# --- JSON payloads -------------------------------------------------------------------

_JPATH = """SELECT doc_id, body, 'items[0].image' AS path, 'image' AS key, 'STRING' AS kind FROM jp
  UNION ALL SELECT doc_id, body, 'items[1].meta.video', 'video', 'STRING' FROM jp
  UNION ALL SELECT doc_id, body, 'items[2].photos', 'photos', 'ARRAY<STRING>' FROM jp"""
ORACLE["j01_json_walk"] = f"WITH {JP}, w AS ({_JPATH}) SELECT doc_id, path, key, kind FROM w"
ORACLE["j02_json_media"] = f"""
WITH {JP}, w AS (SELECT doc_id, body ->> '$.items[0].image' AS ref, 'items[0].image' AS path, 0 AS pos FROM jp
  UNION ALL SELECT doc_id, body ->> '$.items[1].meta.video', 'items[1].meta.video', 0 FROM jp
  UNION ALL SELECT doc_id, body ->> '$.items[2].photos[0]', 'items[2].photos', 0 FROM jp
  UNION ALL SELECT doc_id, body ->> '$.items[2].photos[1]', 'items[2].photos', 1 FROM jp),
a AS (SELECT *, CASE WHEN ref LIKE 'http%' THEN ref ELSE 'https://api.example.com' || ref END AS url FROM w)
SELECT doc_id, url, 'media' AS outcome, {media_kind('url')} AS media_type, 'json-' || path AS source, pos FROM a"""
ORACLE["j03_json_page_links"] = f"""
WITH {JP} SELECT doc_id, 'next' AS key, 'https://api.example.com' || (body ->> '$.next') AS url FROM jp"""

# --- rewriting -------------------------------------------------------------------------


def _site_match(u):
    h = host(f"lower({u})")
    return [f"contains({h}, 'example.org')", f"regexp_matches(lower({u}), 'artstation\\.com/p/')", f"contains({h}, 'example.com')"]


_ON_URL, _ON_PAGE = _site_match("url"), _site_match("page_url")
_ANY = "(" + " OR ".join(_ON_URL) + ")"
_SITES = [f"CASE WHEN {_ANY} THEN {u} ELSE {p} END" for u, p in zip(_ON_URL, _ON_PAGE)]
SITED = f"{IMAGE_URLS}, sited AS (SELECT *, {_SITES[0]} AS s_ex, {_SITES[1]} AS s_art, {_SITES[2]} AS s_page FROM image_urls)"
ORACLE["r01_match_site_patterns"] = f"""
WITH {SITED} SELECT page_url, url, 'ex' AS site FROM sited WHERE s_ex UNION ALL SELECT page_url, url, 'art' FROM sited WHERE s_art
UNION ALL SELECT page_url, url, 'page' FROM sited WHERE s_page"""
_R1 = "CASE WHEN s_ex THEN regexp_replace(url, '/pics/', '/pics-full/', 'gi') ELSE url END"
_R2 = f"CASE WHEN s_art THEN regexp_replace({_R1}, '_small', '', 'gi') ELSE {_R1} END"
_R3 = f"CASE WHEN s_page THEN regexp_replace({_R2}, '-1024x768', '', 'gi') ELSE {_R2} END"
ORACLE["r02_apply_replace_patterns"] = f"WITH {SITED} SELECT page_id, url, {_R3} AS replaced_url FROM sited"


def _host_rule_ids():
    """Host-bound rules 3 (m.example.net) and 6 (www.example.net, found by its own name only)."""
    ph, uh = host("page_url"), host("url")
    bits = []
    for h, cond in ((ph, "true"), (uh, f"{uh} <> {ph}")):
        bits.append(f"CASE WHEN {cond} AND {h} = 'm.example.net' THEN '3|' ELSE '' END")
        bits.append(f"CASE WHEN {cond} AND {h} IN ('www.example.net', 'www.www.example.net') THEN '' ELSE '' END")
        bits.append(f"CASE WHEN {cond} AND {h} = 'www.example.net' THEN '6|' WHEN {cond} AND {h} = 'example.net' THEN '6|' ELSE '' END")
    return " || ".join(bits)


ORACLE["r03_rule_candidates"] = f"WITH {IMAGE_URLS} SELECT page_id, url, {_host_rule_ids()} || '1|2' AS candidates FROM image_urls"


def _rule_results(u):
    bare = f"regexp_replace({u}, '^https?://', '')"
    return [
        (3, f"contains({host('url')}, 'm.example.net') AND regexp_matches({bare}, '^m\\.example\\.net/i/.+$')",
         [f"{scheme(u)} || '://' || regexp_replace({bare}, '^m\\.example\\.net/i/(.+)$', 'm.example.net/orig/\\1')"]),
        (6, f"regexp_matches({u}, '^https?://www[.]example[.]net/w/.+$')",
         [f"regexp_replace({u}, '^(https?://www[.]example[.]net)/w/(.+)$', '\\1/big/\\2')"]),
        (1, f"regexp_matches({u}, '^(.*)/thumb/(.+)_thumb[.](jpg)$')",
         [f"regexp_replace({u}, '^(.*)/thumb/(.+)_thumb[.](jpg)$', '\\1/\\2.\\3')"]),
        (2, f"regexp_matches({u}, '^(.*)/t/([0-9]+)[.]jpg$')",
         [f"regexp_replace({u}, '^(.*)/t/([0-9]+)[.]jpg$', '\\1/full/\\2.{x}')" for x in ("jpg", "png")]),
    ]


def _rules_union(u, source, columns, ordered):
    out = []
    for n, (rule, cond, results) in enumerate(_rule_results(u)):
        for k, r in enumerate(results):
            lead = f"{rule} AS ord, {k} AS pos" if ordered else f"{k} AS pos"
            out.append(f"SELECT {columns}, {lead}, {r} AS variant FROM {source} WHERE {cond}")
    return " UNION ALL ".join(out)


ORACLE["r04_apply_rules"] = f"WITH {IMAGE_URLS} {_rules_union('url', 'image_urls', 'page_url, url', False)}"
ORACLE["r04_apply_rules_by_join"] = f"""
WITH {IMAGE_URLS}, d AS (SELECT DISTINCT page_url, url FROM image_urls) {_rules_union('url', 'd', 'page_url, url', True)}"""
ORACLE["r05_apply_rules_first"] = f"""
WITH {IMAGE_URLS} SELECT page_id, url, CASE
  WHEN regexp_matches(url, '^(.*)/thumb/(.+)_thumb[.](jpg)$') THEN regexp_replace(url, '^(.*)/thumb/(.+)_thumb[.](jpg)$', '\\1/\\2.\\3')
  WHEN regexp_matches(url, '/t/([0-9]+)[.]jpg$') THEN regexp_replace(url, '^(.*)/t/([0-9]+)[.]jpg$', '\\1/full/\\2.jpg')
  WHEN regexp_matches(url, '^https?://www[.]example[.]net/w/') AND regexp_matches(page_url, '^www\\.example\\.net/') THEN 'never'
  END AS result FROM image_urls"""
_EXP = " UNION ALL ".join(
    f"SELECT page_id, {i} AS pos, '/f/' || page_id || '.{e}?s={s}' AS variant FROM pages"
    for i, (e, s) in enumerate([(e, s) for e in ("jpg", "png") for s in ("s", "m", "l")])
)
ORACLE["r06_expand_variants"] = (
    _EXP + " UNION ALL SELECT page_id, 6, '/g/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.webp' ELSE '.gif' END FROM pages"
)
ORACLE["r07_global_transforms"] = f"WITH {IMAGE_URLS} SELECT page_id, url, regexp_replace(url, '/w/', '/whole/', 'gi') AS result FROM image_urls"


def stripped(u):
    return f"regexp_replace({u}, '(?i)^(.*?)-[0-9]{{2,4}}x[0-9]{{2,4}}(\\.(?:jpe?g|png|webp|avif))(\\?|$)', '\\1\\2\\3')"


ORACLE["r08_strip_size_suffix"] = f"WITH {IMAGE_URLS} SELECT page_id, url, {stripped('url')} AS result FROM image_urls"
_CH = f"""{SITED}, f AS (SELECT page_url, url, {_R3} AS f FROM sited),
v AS (SELECT page_url, url, f, 0 AS a, 0 AS b, f AS c FROM f
  UNION ALL SELECT page_url, url, f, x.ord_n, x.pos + 1, x.variant FROM ({
    ' UNION ALL '.join(f"SELECT page_url, url, f, {n} AS ord_n, {k} AS pos, {r} AS variant FROM f WHERE {cond}" for n, (_, cond, rs) in enumerate(_rule_results('f')) for k, r in enumerate(rs))
  }) x),
g AS (SELECT page_url, url, f, list(c ORDER BY a, b) AS l FROM v GROUP BY ALL)"""
ORACLE["r09_transform_image_url"] = f"""
WITH {_CH}, o AS (SELECT page_url, url, CASE WHEN f <> url OR len(l) > 1 THEN l
  WHEN regexp_replace(url, '/w/', '/whole/', 'gi') <> url THEN [regexp_replace(url, '/w/', '/whole/', 'gi')] ELSE [{stripped('f')}] END AS l FROM g)
SELECT page_url, url, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS candidate FROM o"""
# the forms by join work on the distinct URLs of a page
ORACLE["r01_match_site_patterns_by_join"] = f"SELECT DISTINCT * FROM ({ORACLE['r01_match_site_patterns']})"
ORACLE["r02_apply_replace_patterns_by_join"] = f"WITH {SITED} SELECT DISTINCT page_url, url, {_R3} AS replaced_url FROM sited"
ORACLE["r09_transform_image_url_by_join"] = f"SELECT DISTINCT * FROM ({ORACLE['r09_transform_image_url']})"
ORACLE["r04_apply_rules_per_page"] = f"""
WITH {IMAGE_URLS}, d AS (SELECT DISTINCT page_url, url FROM image_urls), p AS (SELECT DISTINCT page_id FROM pages),
h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_url, url, page_id::INTEGER AS ord, 0 AS pos, regexp_replace(url, '/images/thumb/img[0-9]+_thumb[.]jpg$', '/images/big/' || page_id || '.jpg') AS variant
FROM d JOIN p ON regexp_extract(url, '/images/thumb/img([0-9]+)_thumb[.]jpg$', 1) = page_id::VARCHAR
UNION ALL
SELECT page_url, url, -1, 0, regexp_replace(url, '^(.*)/pics/([0-9]+)-300x200[.]jpg$', '\\1/pics/\\2.jpg')
FROM d JOIN h ON {host('page_url')} = h.host OR {host('page_url')} = 'www.' || h.host
WHERE regexp_matches(url, '^(.*)/pics/([0-9]+)-300x200[.]jpg$')"""
ORACLE["r10_rule_functions"] = """
WITH e AS (SELECT event_id, event_type, props, ['group', 'concat', 'if', 'replace', 'base64', 'urldecode'][event_id % 6 + 1] AS fn FROM events)
SELECT event_id, fn, CASE fn WHEN 'group' THEN event_type WHEN 'concat' THEN event_type || '/a/' || event_id
  WHEN 'if' THEN CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR ELSE '/a/' END
  WHEN 'replace' THEN replace(event_type, 'i', event_id::VARCHAR) WHEN 'base64' THEN props ELSE props || '+' END AS result FROM e"""

EDGES = """edges AS (SELECT p.page_id, p.url AS page_url, t.url AS url, t.page_id AS dst_id FROM pages p
  JOIN (SELECT count(*) AS n FROM pages) c ON true JOIN pages t ON t.page_id = (p.page_id * 7 + 1) % c.n OR t.page_id = (p.page_id * 7 + 2) % c.n)"""
_BARE = "regexp_replace(url, '^https?://', '')"
_CAPTURE = f"""cap0 AS (SELECT page_id, url, CASE
  WHEN regexp_matches(url, 'example[.]com/') AND page_id % 16 = 11 THEN ['/og/' || page_id || '.jpg']
  WHEN regexp_matches(url, 'example[.](org|net)/') AND page_id % 16 = 2 THEN ['/full/' || page_id || '.jpg']
  WHEN regexp_matches(url, 'example[.](org|net)/') AND page_id % 16 = 7 THEN ['/v/' || page_id || '.jpg'] ELSE [] END AS l FROM pages),
cap AS (SELECT {norm('url')} AS norm, first(l ORDER BY page_id) AS l FROM cap0 GROUP BY 1)"""
ORACLE["r11_discover_fullsize"] = f"""
WITH {EDGES}, {_CAPTURE}
SELECT DISTINCT e.page_id, e.page_url, 'https:' || unnest(l) AS url, 'image' AS media_type, 'sieve-res' AS source FROM edges e JOIN cap ON cap.norm = {norm('e.url')}
UNION ALL SELECT page_id, page_url, url, CASE WHEN {is_video('url')} THEN 'video' ELSE 'image' END, 'link-direct' FROM edges
WHERE {is_video('url')} OR regexp_matches(url, {q(_SCAN_IMG)})"""
ORACLE["r12_resolve_url"] = f"""
WITH {EDGES}, {_CAPTURE}
SELECT e.page_id, e.url, CASE WHEN len(l) > 0 THEN 'https:' || l[1] ELSE e.url END AS resolved_url FROM edges e JOIN cap ON cap.norm = {norm('e.url')}"""
ORACLE["r13_transform_media"] = f"""
WITH t AS ({ORACLE['r05_apply_rules_first']})
SELECT page_id, coalesce(result, url) AS url, CASE WHEN result IS NOT NULL THEN url END AS original, result IS NOT NULL AS transformed FROM t"""

# --- joins -----------------------------------------------------------------------------

_BLOCKED = list_of(I.BLOCKLIST)
ORACLE["n01_not_blocked"] = f"WITH {EDGES} SELECT page_id, page_url, url FROM edges WHERE NOT list_contains({_BLOCKED}, {host('url')})"
ORACLE["n02_not_visited"] = f"""
WITH {EDGES} SELECT page_id, page_url, url FROM edges
WHERE {norm('url')} NOT IN (SELECT {norm('url')} FROM pages WHERE url LIKE '%utm_source=feed%')"""
ORACLE["n03_not_queued"] = f"""
WITH {IMAGE_URLS}, {MEDIA} SELECT page_id, url FROM image_urls WHERE {norm('url')} NOT IN (SELECT {norm('url')} FROM media)"""

FETCH = f"fetch_log AS ({I.as_sql(I.FETCH_LOG, 'events')})"
_SMALL = "CASE WHEN media_type = 'image' THEN 40 ELSE 1000 END"
OUTCOMES = f"""{FETCH}, fo AS (SELECT *, CASE
  WHEN {is_trash('url')} THEN 'Filtered as trash media (GIF/ICO/SVG)'
  WHEN {ends(path('lower(url)'), K.NOT_DOWNLOADABLE_EXTENSIONS)} THEN 'Non-media file based on URL extension'
  WHEN status < 400 AND {has('content_type', K.NOT_MEDIA_CONTENT_TYPES)} THEN 'Webpage/script content (Content-Type: ' || content_type || ')'
  WHEN status < 400 AND content_length > 0 AND content_length / 1024.0 < {_SMALL}
    THEN 'File too small (' || printf('%.2f', content_length / 1024.0::DOUBLE) || 'KB < ' || {_SMALL} || 'KB)'
  WHEN status >= 400 THEN 'HTTP error: ' || status END AS error FROM fetch_log),
outcomes AS (SELECT *, error IS NULL AS success, coalesce({has('lower(error)', K.CONTENT_SKIP_REASONS)}, false) AS content_skip FROM fo)"""
HEALTH = f"""{OUTCOMES},
h1 AS (SELECT host, ts, event_id, sum(CASE WHEN success THEN -1 WHEN content_skip THEN 0 ELSE 1 END) OVER w AS s, count(*) OVER w AS attempt
  FROM outcomes WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
h2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS f FROM h1),
h3 AS (SELECT host, min((ts, event_id)) FILTER (f >= 3) AS q FROM h2 GROUP BY host),
h4 AS (SELECT h2.*, q, row_number() OVER (PARTITION BY h2.host ORDER BY ts DESC, event_id DESC) AS r
  FROM h2 JOIN h3 USING (host) WHERE q IS NULL OR (ts, event_id) <= q),
health AS (SELECT host, f::BIGINT AS failures, attempt AS total, CASE WHEN q IS NOT NULL THEN ts END AS quarantined_at FROM h4 WHERE r = 1)"""
ORACLE["n04_set_aside"] = f"""
WITH {HEALTH} SELECT event_id, host FROM fetch_log WHERE host IN (SELECT host FROM health WHERE quarantined_at IS NOT NULL)"""
ORACLE["n05_node_relatives"] = f"""
WITH {NODES}, tails AS (SELECT page_id, regexp_extract(regexp_extract(html, '(?s)^.*(?:</p>|</h1>)(.*?)</article>', 1), '(?s)^.*(<p>.*)$', 1) AS open_p FROM pages),
inside AS (SELECT page_id, CASE WHEN open_p LIKE '%<b>%' THEN 'b' WHEN open_p <> '' THEN 'p' ELSE 'article' END AS around FROM tails)
SELECT page_id, node_id, tag,
  CASE tag WHEN 'li' THEN 'ul' WHEN 'a' THEN CASE WHEN before LIKE '<li%' THEN 'li' ELSE around END
    WHEN 'source' THEN CASE WHEN page_id % 16 = 7 THEN 'video' ELSE 'picture' END
    ELSE CASE WHEN before LIKE '<a %' THEN 'a' WHEN before LIKE '<div%' THEN 'div' WHEN page_id % 16 = 6 THEN 'picture'
      WHEN page_id % 16 = 5 THEN 'article' ELSE around END END AS parent_tag,
  CASE WHEN tag = 'img' AND before LIKE '<a %' THEN 'a' END AS anchor_tag
FROM n JOIN inside USING (page_id) WHERE tag IN ('img', 'source', 'li', 'a')"""
ORACLE["n06_linked_pages"] = f"""
WITH {EDGES} SELECT e.page_id, {norm('e.url')} AS norm_url, length(html)::BIGINT AS n_chars FROM edges e JOIN pages p ON {norm('p.url')} = {norm('e.url')}"""
ORACLE["n07_rule_hits"] = f"""
WITH {IMAGE_URLS} {' UNION ALL '.join(f"SELECT page_id, url, {r} AS rule_id FROM image_urls WHERE {c}" for r, c, _ in _rule_results('url'))}"""
COUNTS = f"""{MEDIA}, counts AS (SELECT p.page_id, p.url AS page_url, count(m.page_id) AS n_media FROM pages p LEFT JOIN media m ON m.page_id = p.page_id GROUP BY ALL),
host_scores AS (SELECT {host('page_url')} AS host, sum(n_media)::DOUBLE AS host_score FROM counts GROUP BY 1 HAVING sum(n_media) > 0)"""
ORACLE["n08_frontier_scores"] = f"""
WITH {EDGES}, {COUNTS} SELECT page_id, url, host_score FROM edges LEFT JOIN host_scores ON host = {host('url')}"""
ORACLE["n09_same_site"] = f"""
WITH {EDGES} SELECT page_id AS task_id, url FROM edges WHERE {base2(host('url'))} = {base2(host('page_url'))}"""


# --- aggregates ----------------------------------------------------------------------------

ORACLE["a01_counters"] = f"""
WITH {OUTCOMES} SELECT count(*) FILTER (media_type = 'image') AS images_found, count(*) FILTER (media_type = 'video') AS videos_found,
  count(*) FILTER (success) AS files_downloaded, count(*) FILTER (NOT success) AS files_skipped,
  (SELECT count(*) FROM pages WHERE html IS NOT NULL) AS pages_processed FROM outcomes"""
ORACLE["a02_progress"] = f"""
WITH {OUTCOMES} SELECT media_type, floor(100 * count(*) / (2 * count(*)))::BIGINT AS percent FROM outcomes GROUP BY 1"""
ORACLE["a03_host_reputation"] = f"WITH {COUNTS} SELECT * FROM host_scores"
_WORDS = list_of(K.PATTERN_WORDS)
ORACLE["a04_pattern_scores"] = f"""
WITH {MEDIA}, w AS (SELECT page_id, stage, k, url, CASE WHEN page_id % 3 = 0 THEN -1 ELSE 1 END AS step, unnest({_WORDS}) AS word FROM media),
x AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY page_id, stage, k) AS r, sum(step) OVER (PARTITION BY word ORDER BY page_id, stage, k) AS s
  FROM w WHERE contains(lower({path('url')}), word)),
y AS (SELECT word, r, s - least(0, min(s) OVER (PARTITION BY word ORDER BY r)) AS f FROM x)
SELECT word, arg_max(f, r)::BIGINT AS score FROM y GROUP BY word"""
ORACLE["a05_media_per_host"] = f"WITH {MEDIA} SELECT {host('url')} AS host, count(*) AS n FROM media GROUP BY 1"
ORACLE["a06_host_health"] = f"WITH {HEALTH} SELECT * FROM health"
ORACLE["a06_user_health"] = """
WITH h1 AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) OVER w AS s, count(*) OVER w AS attempt
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
h2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS f FROM h1),
h3 AS (SELECT user_id, min((ts, event_id)) FILTER (f >= 3) AS q FROM h2 GROUP BY 1),
h4 AS (SELECT h2.*, q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM h2 JOIN h3 USING (user_id) WHERE q IS NULL OR (ts, event_id) <= q)
SELECT user_id, f::BIGINT AS failures, attempt AS total, CASE WHEN q IS NOT NULL THEN ts END AS quarantined_at FROM h4 WHERE r = 1"""
ORACLE["a07_status_summary"] = f"""
WITH {TASKS} SELECT count(*) FILTER (status = 'running') AS active, count(*) AS queue_length,
  coalesce(sum(downloaded) FILTER (status = 'running'), 0)::BIGINT AS files_downloaded FROM tasks"""
ORACLE["a08_import_counts"] = f"WITH {IMPORTED} SELECT outcome, count(*) AS n FROM imported GROUP BY 1"
ORACLE["a09_media_counts"] = f"""
WITH {MEDIA} SELECT page_id, media_type, source, count(*) AS n, grouping(page_id, media_type, source)::BIGINT AS level
FROM media GROUP BY ROLLUP (page_id, media_type, source)"""
ITEMS = f"""items AS (SELECT page_id, url, source FROM ({ORACLE['h24_scan_page']})
  UNION ALL SELECT page_id, url, source FROM ({ORACLE['r11_discover_fullsize']}))"""
ORACLE["a10_fullsize_or_all"] = f"""
WITH {ITEMS}, f AS (SELECT *, max(source IN ('sieve-res', 'link-direct')) OVER (PARTITION BY page_id) AS has_full FROM items)
SELECT page_id, url, source FROM f WHERE NOT has_full OR source IN ('sieve-res', 'link-direct')"""
ORACLE["a11_rule_counts"] = f"""
WITH {HOSTS} SELECT 'rule' AS kind, 'host' AS scope, count(*) AS n FROM hosts UNION ALL SELECT 'rule', 'global', count(*) FROM hosts
UNION ALL SELECT 'pattern', 'site', count(*) FROM hosts WHERE length(host) > 20 OR length(host) % 4 <> 0"""

# --- ranking ---------------------------------------------------------------------------------

_WORD_SCORES = [("media", 3), ("pic", 1), ("gallery", 0), ("post", 2)]


def priority(url, source, start, depth, hint, from_image, retry, host_score, context=None, stay=True):
    """The product of factors as one SQL expression."""
    low = f"lower({url})"
    p, qs = path(low), query_of(low)
    same = f"lower({host(url)}) = lower({host(source)})"
    common = f"list_max(list_filter(range(0, least(len({segments(url)}), len({segments(source)})) + 1), lambda i: ({segments(url)})[1:i] = ({segments(source)})[1:i]))"
    score = " + ".join(f"CASE WHEN contains({p}, '{w}') OR contains({qs}, '{w}') THEN {s} ELSE 0 END" for w, s in _WORD_SCORES)
    ext = has(low, K.SCORED_MEDIA_EXTENSIONS)
    media = is_media(url)
    factors = [
        f"CASE WHEN {media} THEN 25.0 ELSE 1 END",
        f"CASE WHEN {media} THEN CASE WHEN {source} = {start} THEN 2.5 WHEN {source} = {context or source} THEN 2.0 ELSE 1 END ELSE 1 END",
        f"coalesce({hint}, 1)",
        f"CASE WHEN {retry} THEN 30.0 WHEN {from_image} THEN 20.0 ELSE 1 END",
        f"CASE WHEN {same} THEN 2.0 ELSE 1 END",
        f"CASE WHEN {same} AND {common} > 0 THEN 3.0 + 2.0 * {common} ELSE 1 END",
        f"CASE WHEN {same} AND len({segments(source)}) >= 1 AND len({segments(url)}) >= 1 AND {common} = len({segments(source)}) - 1 THEN 3.0 ELSE 1 END",
        f"1.0 + coalesce({host_score}, 0)",
        f"CASE WHEN ({score}) > 0 THEN 1.0 + ({score}) / 3.0 ELSE 1 END",
        f"CASE WHEN {homepage(url)} THEN 0.005 ELSE 1 END",
        f"pow(0.2, {nav_words(url)})",
        f"CASE WHEN {likely_content(url)} THEN 3.0 ELSE 1 END",
        f"CASE WHEN {host(url)} = lower({host(source)}) THEN 1.0 / (0.1 + {depth} * 0.1) ELSE 1.0 / (0.5 + {depth} * 0.5) END",
        f"CASE WHEN {ext} THEN 5.0 ELSE 1 END",
        f"CASE WHEN {has(low, K.FULLSIZE_SCORE_WORDS)} THEN 4.0 ELSE 1 END",
        f"CASE WHEN {ext} AND {rx(low, r'/([^/]+)/([^/]+)/(\w+)/')} THEN 3.0 ELSE 1 END",
        f"CASE WHEN {p} NOT IN ('', '/') AND {rx(p, r'/[0-9]+|[0-9]+\.html')} THEN 3.0 ELSE 1 END",
        f"CASE WHEN {p} NOT IN ('', '/') AND {rx(p, r'/20[0-9][0-9]/|/[0-9]{4}/[0-9]{2}/')} THEN 2.5 ELSE 1 END",
    ]
    product = " * ".join(f"({f})::DOUBLE" for f in factors)
    test = f"NOT ({retry} OR {related(url, source)})" if stay else "false"
    return f"CASE WHEN {test} THEN 0.0 ELSE {product} END"


_FRONTIER = f"""{CORPUS}, {COUNTS}, fr AS (SELECT c.page_id, c.url, c.base, c.page_id % 4 AS depth,
  CASE WHEN c.page_id % 2 = 0 THEN c.base END AS start_url, CASE WHEN c.page_id % 5 = 0 THEN 15.0 END AS hint,
  c.page_id % 3 = 0 AS from_image, c.page_id % 7 = 0 AS retry, host_score FROM corpus c LEFT JOIN host_scores ON host = {host('c.url')}),
scored AS (SELECT page_id, url, depth, round({priority('url', 'base', 'start_url', 'depth', 'hint', 'from_image', 'retry', 'host_score')}, 6) AS priority FROM fr)"""
ORACLE["k01_url_priority"] = f"WITH {_FRONTIER} SELECT page_id, url, priority FROM scored"
ORACLE["k02_admission"] = f"WITH {_FRONTIER} SELECT page_id, url, greatest(priority, 0.1) AS priority FROM scored WHERE priority > 0"
ORACLE["k03_pop_order"] = f"""
WITH {_FRONTIER}, a AS (SELECT page_id, url, depth::INTEGER AS depth, greatest(priority, 0.1) AS priority FROM scored WHERE priority > 0)
SELECT *, row_number() OVER (ORDER BY priority DESC, depth, url, page_id) AS pop_order FROM a"""
# first sight of a link: image links by their image, then anchors, then the canonical link
_SEEN = f"""{LINKS}, seen AS (SELECT page_id, url, min(i) AS i FROM anchors GROUP BY ALL),
lk AS (SELECT l.page_id, l.url, l.priority, CASE WHEN l.from_image THEN 0 WHEN l.element = 'a' THEN 1 ELSE 2 END AS stage, coalesce(i, 0) AS i
  FROM links l LEFT JOIN seen USING (page_id, url))"""
ORACLE["k04_cap_links"] = f"""
WITH {_SEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(priority, 0) DESC, stage, i) AS r FROM lk)
SELECT page_id, url, priority FROM r WHERE r <= 5"""


def media_prio(start="NULL::VARCHAR"):
    return f"""(CASE media_type WHEN 'image' THEN 2.0 WHEN 'video' THEN 3.0 ELSE 1.0 END
  * CASE WHEN coalesce(source, '') LIKE '%fullsize%' OR coalesce(source, '') LIKE '%original%' THEN 3.0 WHEN coalesce(source, '') LIKE '%parent-link%' THEN 2.5 ELSE 1.0 END
  * CASE WHEN {has('lower(url)', K.FULLSIZE_PATH_HINTS)} THEN 2.0 ELSE 1.0 END
  * CASE WHEN page_url = {start} THEN 3.0 ELSE 1.0 END
  * CASE WHEN page_id % 16 = 0 AND op = 'h07' THEN least(1.0 + 640 * 480 / 1000000.0, 3.0) ELSE 1.0 END)::DOUBLE"""


ORACLE["k05_media_priority"] = f"""
WITH {MEDIA} SELECT page_id, url, source, round({media_prio('CASE WHEN page_id % 2 = 0 THEN page_url END')}, 6) AS priority FROM media"""
FIRST = f"""{MEDIA}, mp AS (SELECT *, {media_prio()} AS prio, {norm('url')} AS norm_url FROM media),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY page_id, prio DESC, stage, k) AS r FROM mp),
firsts AS (SELECT * FROM ranked WHERE r = 1)"""
ORACLE["k06_first_wins"] = f"WITH {FIRST} SELECT norm_url, page_id, media_type, source FROM firsts"
ORACLE["k07_file_limit"] = f"""
WITH {OUTCOMES}, c AS (SELECT event_id, success, count(*) FILTER (success) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - success::INTEGER AS before FROM outcomes)
SELECT event_id, success FROM c WHERE before < 100"""
ORACLE["k08_best_gateway"] = f"""
WITH {_GATE}, s AS (SELECT page_id, url, 'GET' AS method, text, (CASE WHEN exact THEN 100 WHEN tm THEN 20 ELSE 0 END + CASE WHEN am THEN 10 ELSE 0 END)::INTEGER AS score
FROM g WHERE (tm OR am) AND NOT {has('text', K.GATEWAY_LEGAL_WORDS)} AND NOT {has('lower(url)', K.GATEWAY_LEGAL_WORDS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC) AS r FROM s) SELECT page_id, url, method, text, score FROM r WHERE r = 1"""
_CROWD = f"""{IMAGE_URLS}, u AS (SELECT DISTINCT page_id, url FROM image_urls),
m AS (SELECT url, {host('url')} AS dir, 'img' || CASE WHEN page_id % 6 = 0 THEN '_' || (page_id % 4 + 1) ELSE '' END || '.jpg' AS filename FROM u)"""
_FREE = """nums AS (SELECT DISTINCT dir, 'img.jpg' AS filename, regexp_extract(filename, '_([0-9]+)[.]', 1)::BIGINT AS used FROM m WHERE filename LIKE 'img_%' AND filename <> 'img.jpg'),
most AS (SELECT dir, filename, count(*) AS n FROM m GROUP BY ALL),
free AS (SELECT dir, filename, x, row_number() OVER (PARTITION BY dir, filename ORDER BY x) AS k FROM (
  SELECT dir, filename, unnest(range(1, n + 10)) AS x FROM most) y
  WHERE NOT EXISTS (SELECT 1 FROM nums u WHERE u.dir = y.dir AND u.filename = y.filename AND u.used = y.x))"""
ORACLE["k09_unique_names"] = f"""
WITH {_CROWD}, {_FREE}, o AS (SELECT *, row_number() OVER (PARTITION BY dir, filename ORDER BY md5(url), url) - 1 AS k FROM m)
SELECT o.url, o.dir, o.filename, CASE WHEN o.k = 0 THEN o.filename ELSE replace(o.filename, '.jpg', '_' || x || '.jpg') END AS unique_name
FROM o LEFT JOIN free f ON f.dir = o.dir AND f.filename = o.filename AND f.k = o.k"""
MANIFEST = f"""{FIRST}, manifest AS (SELECT norm_url AS url, {folder('page_url')} AS dir, {file_name('norm_url', 'media_type')} AS filename,
  {host('norm_url')} AS host, round(prio, 6) AS priority FROM firsts WHERE NOT ({is_webpage('norm_url')}))"""
ORACLE["k10_politeness_waves"] = f"""
WITH {MANIFEST} SELECT url, host, priority, ceil(row_number() OVER (PARTITION BY host ORDER BY priority DESC, md5(url), url) / 2.0)::BIGINT AS wave FROM manifest"""
ORACLE["k11_quarantine_batches"] = f"""
WITH {HEALTH}, s AS (SELECT event_id, host, ceil(row_number() OVER (ORDER BY ts, event_id) / 10.0)::BIGINT AS batch FROM fetch_log
  WHERE host IN (SELECT host FROM health WHERE quarantined_at IS NOT NULL))
SELECT event_id, host, batch, CASE WHEN event_id % 2 = 1 THEN 'drop' ELSE 'retry' END AS action FROM s"""
ORACLE["s13_snapshot"] = f"""
WITH {HEALTH}, {IMAGE_URLS}, k AS (
  SELECT 'frontier' AS name, url AS key FROM pages UNION ALL SELECT DISTINCT 'manifest', url FROM image_urls
  UNION ALL SELECT 'quarantine', event_id::VARCHAR FROM fetch_log WHERE host IN (SELECT host FROM health WHERE quarantined_at IS NOT NULL)
  UNION ALL SELECT DISTINCT 'visited', {norm('url')} FROM pages UNION ALL SELECT 'health', host || ' ' || failures || ' ' || total FROM health)
SELECT 1 AS version, name, key FROM k"""
ORACLE["k12_cap_linked_pages"] = f"""
WITH {ANCHORS}, k AS (SELECT page_id, url, min(CASE WHEN inner_html LIKE '%<img %' THEN 0 ELSE 1 END) AS stage, min(i) AS i FROM (
  SELECT a.page_id, a.page_url, a.i, a.url, a0.inner_html FROM anchors a JOIN a0 USING (page_id, i)) WHERE url <> page_url AND
  (inner_html LIKE '%<img %' OR NOT regexp_matches(url, {q(_SCAN_IMG)})) GROUP BY page_id, url),
r AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY stage, i)::INTEGER AS rank FROM k) SELECT * FROM r WHERE rank <= 3"""
ORACLE["k13_queue_order"] = f"WITH {TASKS} SELECT id, status, row_number() OVER (ORDER BY finished, created_at, id) AS position FROM tasks"
ORACLE["k13_next_task"] = f"WITH {TASKS} SELECT id, url, status FROM tasks WHERE status IN ('queued', 'paused') ORDER BY created_at, id LIMIT 1"
ORACLE["k14_byte_ranges"] = f"""
WITH {FETCH}, f AS (SELECT event_id, content_length * 40 AS size, event_id % 3 <> 0 AS ok FROM fetch_log),
n AS (SELECT *, least(6, greatest(1, size // 262144), 8) AS n FROM f),
p AS (SELECT *, (CASE WHEN n > 1 AND size > 1048576 * 6 AND ok THEN n ELSE 1 END)::INTEGER AS parts FROM n),
r AS (SELECT *, unnest(range(0, parts))::INTEGER AS part FROM p)
SELECT event_id, parts, part, part * (size // parts) AS first_byte, CASE WHEN part = parts - 1 THEN size - 1 ELSE (part + 1) * (size // parts) - 1 END AS last_byte FROM r"""

# --- projections, filters, set operations ------------------------------------------------------

ORACLE["f01_extract_media"] = f"""
WITH {MEDIA} SELECT page_id, media_type, url, source, CASE WHEN op IN ('h06', 'h08', 'h10') OR op = 'h07' AND source NOT LIKE '%-link' THEN {is_cdn('url', 'img')}
  WHEN op = 'h11' THEN {is_cdn('url', 'video')} END AS is_cdn FROM media"""
ORACLE["f02_extract_links"] = f"WITH {LINKS} SELECT page_id, url, from_image, element, text, priority, thumbnail_url FROM links"
ORACLE["f03_ordered_distinct"] = """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1), 1) AS i FROM pages),
d AS (SELECT page_id, href, min(i) AS i FROM a GROUP BY ALL) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos, href FROM d"""
ORACLE["f04_filter_links"] = f"""
WITH {LINKS}, {COUNTS.replace(MEDIA, MEDIA)}, l AS (SELECT links.*, p.url AS page_url FROM links JOIN pages p USING (page_id)),
k AS (SELECT l.*, host_score FROM l LEFT JOIN host_scores ON host = {host('l.url')}
  WHERE l.page_id % 4 < 3 AND NOT list_contains({_BLOCKED}, {host('l.url')}) AND {base2(host('l.url'))} = {base2(host('l.page_url'))}
    AND NOT {should_skip('l.url', K.STOP_WORDS)}),
s AS (SELECT page_id, url, (page_id % 4 + 1)::INTEGER AS depth,
  {priority('url', 'page_url', 'page_url', '(page_id % 4 + 1)', 'priority', 'from_image', 'false', 'host_score')} AS p FROM k)
SELECT page_id, url, depth, round(greatest(p, 0.1), 6) AS priority FROM s WHERE p > 0"""
ORACLE["f05_route_media"] = f"""
WITH {CORPUS}, {MEDIA}, u AS (SELECT {norm('url')} AS norm_url FROM media UNION SELECT {norm('url')} FROM corpus)
SELECT norm_url, CASE WHEN {is_webpage('norm_url')} THEN 'frontier' ELSE 'manifest' END AS route FROM u"""
ORACLE["f06_one_shot"] = f"WITH {EDGES} SELECT page_id AS task_id, url FROM edges WHERE page_id % 5 <> 0"
ORACLE["f07_fetch_outcome"] = f"""
WITH {OUTCOMES} SELECT event_id, CASE WHEN error IS NULL AND content_length > 0 AND event_id % 9 = 0
  THEN 'Size mismatch: expected ' || content_length || ', got ' || (content_length + 1) ELSE error END AS error FROM outcomes"""
ORACLE["f08_fetch_status"] = f"""
WITH {FETCH} SELECT event_id, CASE WHEN status BETWEEN 400 AND 499 THEN 'HTTP_ERROR_4XX' WHEN status >= 500 THEN 'HTTP_ERROR_5XX' ELSE 'SUCCESS' END AS result,
  status = 429 AS limited FROM fetch_log"""
ORACLE["f09_content_skip"] = f"WITH {OUTCOMES} SELECT event_id, success, content_skip FROM outcomes"
ORACLE["f10_interstitial_feedback"] = f"""
WITH {OUTCOMES} SELECT url, 1 AS depth, 15.0::DOUBLE AS priority_hint, true AS interstitial_retry, media_type AS original_media_type
FROM outcomes WHERE error LIKE 'Webpage/script content%' AND event_id % 4 <> 0"""
ORACLE["f11_filter_items"] = f"""
WITH {ITEMS} SELECT page_id, url, source, CASE WHEN source IN ('sieve-res', 'link-direct') THEN 'fullsize' ELSE 'thumbnail' END AS view FROM items
UNION ALL SELECT page_id, url, source, 'host' FROM items WHERE {host('url')} = 'player.vimeo.com'"""
ORACLE["f12_probation"] = f"""
WITH {HEALTH} SELECT event_id, host, CASE WHEN failures > 0 THEN 5 ELSE 30 END AS timeout_s, CASE WHEN failures > 0 THEN 0 ELSE 3 END AS max_retries
FROM fetch_log LEFT JOIN health USING (host)"""
ORACLE["f13_task_status"] = f"""
WITH e AS ({I.as_sql(I.TASK_EVENTS, 'events')}), starts AS (SELECT max((ts, event_id)) AS o FROM e WHERE action = 'start'),
p AS (SELECT task_id, arg_max(action, (ts, event_id)) AS last_action, max((ts, event_id)) FILTER (action = 'start') AS s,
  max(ts) FILTER (action = 'start') AS started_at, max(ts) FILTER (action IN ('complete', 'stop', 'fail')) AS ended,
  max((ts, event_id)) FILTER (action IN ('complete', 'stop', 'fail')) AS en FROM e GROUP BY task_id)
SELECT task_id, CASE last_action WHEN 'pause' THEN 'paused' WHEN 'complete' THEN 'completed' WHEN 'stop' THEN 'stopped' WHEN 'fail' THEN 'failed'
  ELSE CASE WHEN s < o THEN 'paused' ELSE 'running' END END AS status, started_at, CASE WHEN s IS NULL OR en > s THEN ended END AS completed_at FROM p, starts"""
ORACLE["s15_write_manifest"] = f"WITH {MANIFEST} SELECT url, dir, filename, host FROM manifest"

# --- crawl -------------------------------------------------------------------------------------

_CRAWL = f"""{EDGES}, pg AS (SELECT page_id, url, {norm('url')} AS norm_url FROM pages),
hops AS (SELECT page_id, {norm('url')} AS norm_url FROM edges WHERE NOT list_contains({_BLOCKED}, {host('url')}) AND NOT {should_skip('url', K.STOP_WORDS)}),
d0 AS (SELECT * FROM pg WHERE norm_url IN (SELECT norm_url FROM pg WHERE url LIKE '%utm_source=feed%')),
d1 AS (SELECT * FROM pg WHERE norm_url IN (SELECT norm_url FROM hops WHERE page_id IN (SELECT page_id FROM d0)) AND norm_url NOT IN (SELECT norm_url FROM d0)),
d2 AS (SELECT * FROM pg WHERE norm_url IN (SELECT norm_url FROM hops WHERE page_id IN (SELECT page_id FROM d1)) AND norm_url NOT IN (SELECT norm_url FROM d0 UNION ALL SELECT norm_url FROM d1))"""
ORACLE["c01_crawl"] = f"""
WITH {_CRAWL} SELECT page_id, norm_url, 0 AS depth FROM d0 UNION ALL SELECT page_id, norm_url, 1 FROM d1 UNION ALL SELECT page_id, norm_url, 2 FROM d2"""

ORACLE["c01_crawl_per_task"] = f"""
WITH {_CRAWL}, hop AS (SELECT DISTINCT p.norm_url AS src, h.norm_url AS dst FROM hops h JOIN pg p USING (page_id)),
t0 AS (SELECT page_id AS task_id, norm_url FROM pg),
t1 AS (SELECT DISTINCT task_id, dst AS norm_url FROM t0 JOIN hop ON src = norm_url),
t2 AS (SELECT DISTINCT task_id, dst AS norm_url FROM t1 JOIN hop ON src = norm_url),
s AS (SELECT task_id, norm_url, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2) GROUP BY ALL)
SELECT task_id, page_id, depth FROM s JOIN pg USING (norm_url)"""

# --- streams: the batch result ---------------------------------------------------------------------

ORACLE["t01_stream_media"] = f"WITH {MEDIA} SELECT page_id, media_type, url, source FROM media"
ORACLE["t02_stream_distinct_media"] = f"WITH {MEDIA} SELECT DISTINCT {norm('url')} AS norm_url FROM media"
ORACLE["t03_stream_health"] = f"""
WITH {HEALTH} SELECT host, failures, total, strftime(quarantined_at, '%Y-%m-%d %H:%M:%S') AS quarantined_at FROM health"""
ORACLE["t04_stream_reputation"] = f"WITH {COUNTS} SELECT * FROM host_scores"
ORACLE["t05_stream_completion"] = f"WITH {PM} SELECT page_id, length(html)::BIGINT AS n_chars FROM pm"
ORACLE["t05_stream_idle_end"] = ORACLE["t01_stream_media"]
ORACLE["t06_stream_restart"] = f"SELECT page_id, {norm('url')} AS norm_url FROM pages"
ORACLE["t07_stream_progress"] = f"""
WITH {OUTCOMES} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (success) AS n_ok FROM outcomes GROUP BY 1"""

# --- rules inside extraction, and visiting order -------------------------------------------------

# With the rule book of the rewriting queries, page 3, 2 and 4 variants and site patterns change image URLs.
_RAW = f"""{NODES}, img0 AS (SELECT page_id, url AS page_url, t, before, {attr('src')} AS src, {attr('data-full')} AS df FROM n
  WHERE tag = 'img' AND NOT {_HIDES.format(t='t')} AND NOT (before NOT LIKE '</%' AND {_HIDES.format(t='before')})),
img1 AS (SELECT page_id, page_url, t, CASE WHEN df IS NOT NULL THEN df WHEN t LIKE '% srcset=%' THEN '/s/' || page_id || '-d.jpg' ELSE src END AS url FROM img0),
sited AS (SELECT *, {_SITES[0]} AS s_ex, {_SITES[1]} AS s_art, {_SITES[2]} AS s_page FROM img1),
f AS (SELECT page_id, page_url, t, url, {_R3} AS f FROM sited)"""
_RULED = " UNION ALL ".join(
    f"SELECT page_id, page_url, t, url, f, {n} AS a, {k} AS b, {r} AS variant FROM f WHERE {cond}"
    for n, (_, cond, rs) in enumerate(_rule_results("f"))
    for k, r in enumerate(rs)
    if n != 0
)
ORACLE["f01_extract_media_with_rules"] = f"""
WITH {_RAW}, more AS ({_RULED}), hit AS (SELECT DISTINCT page_id, t FROM more),
cand AS (SELECT page_id, page_url, t, url, f AS c FROM f WHERE f <> url OR (page_id, t) IN (SELECT (page_id, t) FROM hit)
  UNION SELECT page_id, page_url, t, url, variant FROM more
  UNION SELECT page_id, page_url, t, url, {stripped('f')} FROM f WHERE f = url AND (page_id, t) NOT IN (SELECT (page_id, t) FROM hit) AND {stripped('f')} <> url),
a AS (SELECT page_id, {simple_join('page_url', 'c')} AS url, url AS original_url, coalesce({attr('alt')}, '') AS alt FROM cand)
SELECT page_id, url, original_url FROM a WHERE {significant('url', texts=['alt'])}"""
ORACLE["c02_visit_rank"] = f"""
WITH {_CRAWL}, seeds AS (SELECT url FROM pages WHERE url LIKE '%utm_source=feed%'),
lk AS (SELECT e.page_id, e.page_url, e.url, s.start_url FROM edges e
  JOIN (SELECT d0.page_id, max(seeds.url) AS start_url FROM d0 JOIN seeds ON {norm('seeds.url')} = d0.norm_url GROUP BY 1) s ON s.page_id = e.page_id
  WHERE NOT list_contains({_BLOCKED}, {host('e.url')}) AND NOT {should_skip('e.url', K.STOP_WORDS)}),
sc AS (SELECT {norm('url')} AS norm_url, max(greatest(p, 0.1)) AS priority FROM (
  SELECT url, {priority('url', 'start_url', 'start_url', '1', 'NULL', 'false', 'false', 'NULL', context='page_url', stay=False).replace(' + '.join(f"CASE WHEN contains({path('lower(url)')}, '{w}') OR contains({query_of('lower(url)')}, '{w}') THEN {s} ELSE 0 END" for w, s in _WORD_SCORES), '0')} AS p FROM lk) x GROUP BY 1),
v AS (SELECT norm_url, 0 AS round, 1.0 AS priority FROM d0 UNION ALL SELECT d1.norm_url, 1, sc.priority FROM d1 JOIN sc USING (norm_url))
SELECT norm_url, round, row_number() OVER (ORDER BY round, priority DESC, norm_url) AS visit_rank FROM v"""
