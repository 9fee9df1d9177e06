from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaweave.functions import urls as U
from mediaweave.functions.sql import register_functions

SITE = "https://example.com"
MEDIA = ["/image.jpg", "/video.mp4", "/document.pdf", "/images/photo.png", "/images/gallery/", "/download/file?name=image.jpg"]
PAGES = ["/page.html", "/index.php", "/article.asp", "/profile.jsp", "/gallery.aspx"]


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "u string").select(fn("u")).first()[0]


def values(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, u string")
    return [r[0] for r in rows.select(fn("u").alias("v"), "i").orderBy("i").collect()]


def test_media_examples(spark):
    texts = [SITE + p for p in MEDIA] + ["https://cdn.example.com/image.jpg"]
    assert values(spark, texts, U.is_media_url) == [True] * len(texts)
    assert values(spark, [SITE + p for p in PAGES], U.is_media_url) == [False] * len(PAGES)


def test_image_and_video_examples(spark):
    texts = [SITE + p for p in ("/image.jpg", "/photo.png", "/video.mp4", "/page.html")]
    assert values(spark, texts, U.is_image_url) == [True, True, False, False]
    texts = [SITE + p for p in ("/video.mp4", "/movie.webm", "/image.jpg", "/page.html")]
    assert values(spark, texts, U.is_video_url) == [True, True, False, False]


@pytest.mark.parametrize(
    ("url", "skip"),
    [
        ("https://example.com/privacy/policy", True),
        ("https://example.com/gallery/photo/123", False),
        ("https://cdn.example.com/media/uploads/1.jpg", False),
        ("https://example.com/about-us", True),
        ("https://x.doubleclick.net/a", True),
        ("https://example.com/a.css", True),
        ("", True),
    ],
)
def test_should_skip(spark, url, skip):
    assert value(spark, url, U.should_skip_crawl_url) is skip


def test_significance_examples(spark):
    rows = [
        ("https://example.com/thumbnail/120/foo.jpg", None, None, True),
        ("https://example.com/pixel.gif", None, None, False),
        ("https://example.com/a.jpg", "728", "90", False),
        ("https://example.com/a.jpg", "50", "500", False),
        ("https://example.com/a.jpg", "", "", True),
        ("https://example.com/uploads/a.jpg", None, None, False),  # "ads" is a substring test
    ]
    df = spark.createDataFrame(rows, "u string, w string, h string, expected boolean")
    got = df.select("*", U.is_significant("u", "w", "h").alias("got")).collect()
    assert [r["got"] for r in got] == [r["expected"] for r in got]


def test_quirks(spark):
    assert value(spark, "https://www.pinterest.com/x", U.video_platform) == "twitter"  # "t.co" is unanchored
    assert value(spark, "https://a.example/app.ts", U.is_media_url) is True
    assert value(spark, "https://a.example/x.jpg;v=1", U.is_image_url) is True
    assert value(spark, "https://a.jpg", U.is_trash_media) is False
    assert value(spark, "https://host.gif", U.is_trash_media) is False


def py_normalize(url):
    p = urlparse(url)
    path = p.path[:-1] if p.path.endswith("/") and len(p.path) > 1 else p.path
    return p._replace(scheme=p.scheme.lower(), netloc=p.netloc.lower(), path=path, fragment="").geturl()


SEGMENT = st.sampled_from(["a", "b.html", "..", ".", "", "é|x", "c;p=1", "d e"])
PATH = st.lists(SEGMENT, max_size=5).map("/".join)
TAIL = st.sampled_from(["", "?q=1", "?a=b/c", "#f", "?x=1#y"])
BASE = st.builds(
    lambda h, p, t: f"{h}/{p}{t}", st.sampled_from(["http://A.com", "https://x.org:80"]), PATH, TAIL
)


@settings(max_examples=1, deadline=None, phases=[Phase.generate], derandomize=True)
@given(st.lists(st.tuples(BASE, PATH, TAIL), min_size=400, max_size=400))
def test_join_and_normalize_agree_with_the_standard_library(spark, cases):
    rows = []
    for base, ref, tail in cases:
        rows.append((base, ref + tail, urljoin(base, ref + tail), py_normalize(base)))
    df = spark.createDataFrame(rows, "b string, r string, joined string, norm string")
    got = df.select("*", U.url_join("b", "r").alias("gj"), U.normalize_url("b").alias("gn")).collect()
    assert [(r["b"], r["r"], r["gj"]) for r in got if r["gj"] != r["joined"]] == []
    assert [(r["b"], r["gn"]) for r in got if r["gn"] != r["norm"]] == []


def test_normalize_is_idempotent(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(U.normalize_url("url").alias("n"))
    assert pages.filter(U.normalize_url("n") != F.col("n")).count() == 0


def test_file_names(spark):
    cases = {
        'a<b>:c?.jpg': "a_b_c_.jpg",
        "  x  y .png": "x_y_.png",
        "???": "",
        ".jpg": ".jpg",
        "n" * 300 + ".longextension": "n" * 200 + ".longex",
    }
    got = values(spark, list(cases), U.sanitize_filename)
    for (name, want), have in zip(cases.items(), got):
        if want:
            assert have == want
        else:
            assert len(have) == 14 and have.endswith(".jpg")


def test_sql_functions_equal_the_columns(spark, sf_dir):
    register_functions(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.createOrReplaceTempView("pages_v")
    sql = spark.sql("select url, normalize_url(url) n, url_host(url) h, base_domain(url) b, is_trash_media(url || '.gif') t, url_path(url) p from pages_v")
    bad = sql.filter(
        (F.col("n") != U.normalize_url("url")) | (F.col("h") != U.get_domain("url")) | (F.col("p") != U.path("url"))
        | (F.col("b") != U.base_domain("url")) | (F.col("t") != U.is_trash_media(F.concat("url", F.lit(".gif"))))
    )
    assert sql.count() > 0 and bad.count() == 0
