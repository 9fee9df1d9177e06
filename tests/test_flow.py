"""Frontier, crawl, fetch results, files and streams."""

import datetime as dt
from collections import deque

import pytest
from pyspark.sql import functions as F

from mediaweave.functions import urls as U
from mediaweave.operators import frontier as Fr
from mediaweave.operators import health as H
from mediaweave.operators import jsonmedia as J
from mediaweave.operators import tasks as Tk
from mediaweave.plans import inputs as I
from mediaweave.plans.crawl import crawl
from mediaweave.sources import files as Fs
from mediaweave.sources import pages as P
from mediaweave.streaming import streams as St
from test_ordered import brute_health


def test_blocked_hosts_are_dropped(spark):
    hosts = spark.createDataFrame([("blockeddomain.com",), ("anotherblock.org",)], "host string")
    links = spark.createDataFrame(
        [
            ("http://gooddomain.com/a",), ("http://gooddomain.com/b",), ("http://blockeddomain.com/x",),
            ("https://anotherblock.org/y",), ("ftp://blockeddomain.com/z",),
        ],
        "url string",
    )
    assert {r["url"] for r in Fr.not_blocked(links, hosts).collect()} == {"http://gooddomain.com/a", "http://gooddomain.com/b"}
    sub = spark.createDataFrame([("http://sub.blockeddomain.com/x",)], "url string")
    assert Fr.not_blocked(sub, hosts).count() == 1  # the whole host is compared


@pytest.mark.parametrize(
    ("url", "kind", "status", "ctype", "size", "expected"),
    [
        ("https://example.com/page.html", "image", 200, "image/jpeg", 99999, "Non-media file based on URL extension"),
        ("https://example.com/script.js", "image", 200, "image/jpeg", 99999, "Non-media file based on URL extension"),
        ("https://example.com/content", "image", 200, "text/html", 1000, "Webpage/script content (Content-Type: text/html)"),
        ("https://example.com/a.gif", "image", 200, "image/gif", 99999, "Filtered as trash media (GIF/ICO/SVG)"),
        ("https://example.com/a.jpg", "image", 200, "image/jpeg", 40959, "File too small (40.00KB < 40KB)"),
        ("https://example.com/a.jpg", "image", 200, "image/jpeg", 40960, None),
        ("https://example.com/a.mp4", "video", 200, "video/mp4", 40960, "File too small (40.00KB < 1000KB)"),
        ("https://example.com/a.jpg", "image", 503, "text/html", 10, "HTTP error: 503"),
        ("https://example.com/a.jpg", "image", None, None, None, "Network error"),
    ],
)
def test_fetch_errors(spark, url, kind, status, ctype, size, expected):
    row = [(url, kind, status, ctype, size)]
    df = spark.createDataFrame(row, "url string, media_type string, status int, content_type string, content_length long")
    assert df.select(H.fetch_error()).first()[0] == expected


def test_related_urls(spark):
    rows = [
        ("https://a.com/x/y/z", "https://a.com/x/y", True),
        ("https://a.com/x/yz", "https://a.com/x/y", True),  # same first folder
        ("https://b.com/x", "https://a.com/x", False),
        ("https://a.com/x", "https://sub.a.com/x", False),  # a parent host
        ("https://sub.a.com/x/1", "https://a.com/x", True),
        ("https://a.com/", "https://a.com/", False),
        ("https://a.com/u/v/w", "https://a.com/x/y", False),
        ("https://a.com/blog/v/w", "https://a.com/news/y/z", True),
        ("https://a.com/p/77/q", "https://a.com/p/12", True),
        ("https://a.com/u/v", "https://a.com/x", True),
    ]
    df = spark.createDataFrame(rows, "u string, s string, e boolean").select("*", U.is_related("u", "s").alias("g"))
    assert [r["g"] for r in df.collect()] == [r[2] for r in rows]


def test_crawl_reaches_what_a_breadth_first_walk_reaches(spark, sf_dir):
    pages = I.pages(spark, sf_dir).select("page_id", "url")
    links = I.page_links(spark, sf_dir).select("page_id", F.col("src_url").alias("page_url"), F.col("dst_url").alias("url"))
    full = links.withColumns({"first_seen": F.col("url"), "priority": F.lit(None).cast("double"), "from_image": F.lit(False)})
    blocked = I.blocklist(spark)
    seeds = pages.orderBy("page_id").limit(2)
    media = pages.select("page_id", (F.col("page_id") % 3).alias("n_media"))
    seen = crawl(pages, full, seeds, blocked, 3, False, media).collect()
    got = {r["norm_url"]: r["depth"] for r in seen}
    assert len(got) == len({(r["norm_url"], r["page_id"]) for r in seen})

    norm = {r["url"]: r["n"] for r in pages.select("url", U.normalize_url("url").alias("n")).collect()}
    allowed = Fr.not_blocked(links, blocked).filter(~U.should_skip_crawl_url("url", None)).collect()
    out = {}
    for r in allowed:
        out.setdefault(norm[r["page_url"]], set()).add(norm[r["url"]])
    want, queue = {}, deque((norm[r["url"]], 0) for r in seeds.collect())
    while queue:
        url, depth = queue.popleft()
        if url in want or depth > 3:
            continue
        want[url] = depth
        queue.extend((u, depth + 1) for u in out.get(url, ()))
    assert got == want


def test_no_blocked_host_in_the_frontier(spark, sf_dir):
    links = I.page_links(spark, sf_dir).select(
        "page_id", F.col("src_url").alias("page_url"), F.col("dst_url").alias("url"), F.col("dst_url").alias("first_seen"),
        F.lit(None).cast("double").alias("priority"), F.lit(False).alias("from_image"), F.col("src_url").alias("start_url"),
    )
    rows = Fr.filter_links(links, I.blocklist(spark), F.lit(0), stay_in_domain=False)
    assert rows.count() > 0
    assert rows.filter(U.get_domain("url").isin(I.BLOCKLIST)).isEmpty()
    assert rows.filter("priority < 0.1").isEmpty()


def test_json_payload_shapes(spark):
    rows = [
        (1, "http://a/", '{"a":{"image":{"url":"x.jpg"},"imgs":[{"url":"b.jpg"},{"url":"c.gif"},"d.gif",{"z":1},5]},"q":[[{"src":"/p.html"}]]}'),
        (2, "http://a/", "garbage"),
        (3, "http://a/", '[{"photo":"//cdn.x/y.png"},{"files":"s.zip/"},{"link":"icon.svg"}]'),
        (4, "http://a/", '{"paging":{"url":"/n"},"next":"/m","links":["/no"]}'),
    ]
    p = J.read_payloads(spark.createDataFrame(rows, "doc_id long, url string, body string"))
    got = {(r["doc_id"], r["url"], r["outcome"], r["media_type"]) for r in J.json_media(p).collect()}
    assert got == {
        (1, "http://a/b.jpg", "media", "image"), (1, "http://a/c.gif", "link", None), (1, "http://a/d.gif", "media", "image"),
        (1, "http://a/p.html", "link", None), (3, "http://cdn.x/y.png", "media", "image"), (3, "http://a/s.zip/", "link", None),
        (3, "http://a/icon.svg", "link", None), (4, "http://a/n", "link", None),
    }
    paging = {(r["doc_id"], r["url"]) for r in J.json_page_links(p).collect()}
    assert paging == {(4, "http://a/n"), (4, "http://a/m")}


def test_task_files_round_trip(spark, sf_dir, tmp_path):
    stamps = {c: F.col(c).cast("timestamp") for c in ("created_at", "started_at", "completed_at")}
    tasks = I.tasks(spark, sf_dir).withColumns(stamps)
    Fs.export_tasks_csv(tasks, str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf#,ID,URL,Status,Downloaded,Found,Created,Started,Completed,Path")
    back = Fs.read_tasks_csv(spark, str(tmp_path / "csv"))
    assert back.count() == tasks.count() and back.columns[0] == "#"
    outputs = tasks.limit(3).select(F.col("download_path").alias("path"), F.lit(2).alias("n_files"))
    counts = {r["outcome"]: r["n"] for r in Tk.outcome_counts(Tk.import_rows(back, outputs, F.current_timestamp())).collect()}
    assert counts == {"restored": 3, "queued": tasks.count() - 3}
    Fs.write_tasks_json(tasks.drop("task_id", "files_downloaded"), str(tmp_path / "json"))
    saved = Fs.read_tasks_json(spark, str(tmp_path / "json"))
    assert saved.filter("status = 'running'").isEmpty() and saved.count() == tasks.count()


def test_decoding(spark, tmp_path):
    texts = {
        "a.html": "naïve ✓".encode(),
        "b.html": b"\xef\xbb\xbf" + "é".encode(),
        "c.html": "é✓".encode("utf-16"),
        "d.html": b'<meta charset="windows-1251">' + "да".encode("cp1251"),
        "e.html": b"bad \xff byte",
    }
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["url"].rsplit("/", 1)[1]: r["html"] for r in P.read_raw_pages(spark, str(tmp_path)).collect()}
    assert got["a.html"] == "naïve ✓" and got["b.html"] == "é" and got["c.html"] == "é✓"
    assert got["d.html"].endswith("да") and got["e.html"] == "bad � byte"


def test_blocklist_file(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# no\n\n  a.example \nb.example\na.example\n")
    assert sorted(r["host"] for r in P.read_blocklist(spark, str(tmp_path / "b.txt")).collect()) == ["a.example", "b.example"]


def fetch_rows(n=240):
    import random

    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    return [
        (i, rng.choice(["hot"] * 4 + ["a", "b", "c"]), start + dt.timedelta(minutes=10 * i), rng.random() < 0.55, False)
        for i in range(n)
    ]


FETCH = "event_id long, host string, ts timestamp, success boolean, content_skip boolean"


def test_health_stream_equals_the_batch(spark, tmp_path):
    """Several micro-batches give what one ordered pass gives."""
    rows = fetch_rows()
    for n in range(4):
        part = spark.createDataFrame(rows[n * 60 : n * 60 + 60], FETCH).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = St.HealthStream(spark, str(tmp_path / "state"), dt.timedelta(days=999))
    stream.run(St.read_stream(spark, str(tmp_path / "in"), FETCH, files_per_batch=1), str(tmp_path / "check"))
    got = {r["host"]: r for r in stream.state(3).collect()}
    for host, want in brute_health(rows).items():
        assert (got[host]["failures"], got[host]["total"], got[host]["quarantined_at"]) == (want["failures"], want["total"], want["at"])
    assert sum(r["total"] + r["waiting"] for r in got.values()) == len(rows)


def test_quarantine_is_released(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    bad = [(i, "h", t + dt.timedelta(minutes=i), False, False) for i in range(4)]
    later = [(9, "h", t + dt.timedelta(hours=2), True, False)]
    stream = St.HealthStream(spark, str(tmp_path / "state"), dt.timedelta(hours=1))
    stream(spark.createDataFrame(bad, FETCH), 0)
    first = stream.state(0).first()
    assert (first["failures"], first["total"], first["waiting"]) == (3, 3, 1) and first["quarantined_at"] is not None
    stream(spark.createDataFrame(later, FETCH), 1)
    second = stream.state(1).first()
    assert (second["failures"], second["total"], second["quarantined_at"]) == (0, 4, None)


def test_stream_restart_loses_and_repeats_nothing(spark, sf_dir, tmp_path):
    pages = I.pages(spark, sf_dir).withColumn("fetched_at", F.timestamp_seconds("page_id"))
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    half = pages.count() // 2
    for part in (pages.filter(F.col("page_id") < half), pages.filter(F.col("page_id") >= half)):
        part.write.mode("append").parquet(folder)
        St.run_available(St.read_stream(spark, folder, St.PAGE_SCHEMA).select("page_id"), check, path=out)
    got = spark.read.parquet(out)
    assert got.count() == pages.count() and got.distinct().count() == pages.count()


@pytest.mark.parametrize(
    "name",
    ["t01_stream_media", "t02_stream_distinct_media", "t03_stream_health", "t04_stream_reputation", "t05_stream_completion", "t07_stream_progress"],
)
def test_streams_of_tables_in_several_files(spark, sf_dir, tmp_path, name):
    """A table that is a folder of files streams as one that is a single file."""
    from mediaweave.plans.queries import QUERIES

    for table in ("pages", "events"):
        I.table(spark, sf_dir, table).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, wanted = (sorted(map(repr, QUERIES[name](spark, folder).collect())) for folder in (str(tmp_path), sf_dir))
    assert got == wanted and got


def test_payload_tasks_hold_bounded_rows(spark, sf_dir, monkeypatch):
    """A task walks at most about ``J.ROWS`` payloads, however large the table is."""
    from mediaweave.plans.queries import _payloads

    monkeypatch.setattr(J, "ROWS", 20)
    rows = _payloads(spark, sf_dir)
    assert rows.rdd.getNumPartitions() >= rows.count() / 20
    deep = spark.createDataFrame([('{"a":[{"b":[[{"image":"x"}]]}],"[{":1}',)], "body string").select("body", J.parse_payload(F.col("body")).alias("p"))
    assert deep.select(F.transform(J.media_values(F.col("p"), F.col("body")), lambda m: m["path"])).first()[0] == ["a[0].b[0][0].image"]
