from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from mediaweave.functions.rewrite import RuleBook
from mediaweave.operators import links as L
from mediaweave.operators import media as M
from mediaweave.operators import scan as S
from mediaweave.operators.nodes import is_visible, nodes, with_relative
from mediaweave.operators.scanner import scan_page
from mediaweave.plans import inputs as I
from mediaweave.plans.queries import requoted
from mediaweave.streaming import streams as St


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, dict(reversed([(k, v or "") for k, v in attrs]))))


def test_scan_agrees_with_the_standard_parser(spark, sf_dir):
    for row in I.pages_media(spark, sf_dir).collect():
        reader = Reader()
        reader.feed(row["html"])
        reader.close()
        assert [(r[4], r[5]) for r in scan_page(row["page_id"], row["url"], row["html"])] == reader.found


def test_requoted_pages_say_the_same(spark, sf_dir):
    """On all pages, those with scripts and quoted data too."""
    pages = I.pages_media(spark, sf_dir).collect()
    other = {r["page_id"]: r["html"] for r in requoted(I.pages_media(spark, sf_dir)).collect()}
    for row in pages:
        html = other[row["page_id"]]
        assert [r[4:6] for r in scan_page(1, "u", html)] == [r[4:6] for r in scan_page(1, "u", row["html"])]
        scripts, same = ([x.split("</script>")[0] for x in h.split("<script")[1:]] for h in (html, row["html"]))
        assert scripts == same
    changed = {r["page_id"] % 16 for r in pages if other[r["page_id"]] != r["html"] and r["page_id"] % 3 == 1}
    assert changed == set(range(16))


def test_implied_end_tags():
    rows = scan_page(1, "u", "<ul><li>a<li>b</ul><p>x<p>y<div>z</div><table><tr><td>1<td>2<tr><td>3</table>")
    tags = {r[2]: r[4] for r in rows}
    assert [(r[4], tags.get(r[3])) for r in rows] == [
        ("ul", None), ("li", "ul"), ("li", "ul"), ("p", None), ("p", None), ("div", None), ("table", None),
        ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"),
    ]


def test_raw_text_entities_and_broken_markup():
    rows = scan_page(1, "u", '<script>if(a<b){"<p>"}</script><a href="/x?a=1&amp;b=2">T &amp; U</a><img src="open')
    assert [r[4] for r in rows] == ["script", "a"]
    assert rows[0][8] == 'if(a<b){"<p>"}'
    assert rows[1][5] == {"href": "/x?a=1&b=2"} and rows[1][7] == "T & U"


def test_media_totals_follow_from_the_page_id(spark, sf_dir):
    per_variant = [1, 1, 2, 2, 2, 0, 2, 2, 1, 4, 1, 2, 3, 3, 0, 0]
    media = M.extract_media(nodes(I.pages_media(spark, sf_dir), marked_only=True))
    got = dict(media.groupBy("page_id").count().collect())
    noisy = I.pages(spark, sf_dir).filter(F.col("url").contains("ads-")).select("page_id").collect()
    skip = {r[0] for r in noisy}
    for page_id in range(50):
        if page_id not in skip:
            assert got.get(page_id, 0) == per_variant[page_id % 16], page_id


def urls(df):
    return [(r["media_type"], r["url"], r["source"]) for r in df.orderBy("stage", "owner", "pos").collect()]


BASE = "https://site.example/a/"


def test_best_image_order(one_page):
    n = one_page(
        '<img src="s.jpg" data-hires="h.jpg" data-original="o.jpg">'
        '<img src="s2.jpg" width="1200" height="900" data-src="l.jpg">'
        '<img srcset="a.jpg 50w, b.jpg 90w">'
        '<img data-foo="x.webp">'
    )
    best = n.filter("tag = 'img'").select("node_id", F.explode(F.array(M.best_image(F.col("attrs")))).alias("b"))
    got = [(r["b"]["url"], r["b"]["rank"], r["b"]["source"]) for r in best.orderBy("node_id").collect()]
    assert got == [
        ("o.jpg", 999999, "data-original"),  # the any-attribute rank beats the named one
        ("s2.jpg", 1200, "src"),
        ("a.jpg 50w, b.jpg 90w", 0, "srcset"),  # small candidates lose to the raw attribute, whose rank is 0
        ("x.webp", 0, "data-foo"),
    ]


def test_linked_images(one_page):
    n = one_page(
        '<a href="big.jpg"><img src="t1.jpg"></a>'
        '<a href="page.html"><img src="t2.jpg"></a>'
        '<a href="x.gif"><img src="t3.jpg"></a>'
        '<a href="/media/full/9"><img src="t4.jpg"></a>'
        '<a href="p5.html" style="display:none"><img src="t5.jpg"></a>'
        '<a href="p6.html"><img src="icon.jpg"></a>'
    )
    # the last two: the image is hidden by its parent's style; a noise image still queues its page
    assert urls(M.extract(n, M.img_images())) == [
        ("image", BASE + "t1.jpg", "src"),
        ("image", BASE + "big.jpg", "parent-link"),
        ("image", BASE + "t3.jpg", "src"),
        ("image", "https://site.example/media/full/9", "fullsize-link"),
    ]
    links = {r["url"]: (r["priority"], r["potential_media_container"]) for r in L.image_links(n).collect()}
    assert links == {
        BASE + "page.html": (15.0, None),
        BASE + "x.gif": (10.0, None),
        "https://site.example/media/full/9": (15.0, None),
        BASE + "p6.html": (15.0, True),
    }


def test_retry_keeps_more(one_page):
    n = one_page('<img src="/ads/a.jpg"><img src="/x/icon.jpg"><a href="b.html"><img src="c.jpg"></a>', BASE + "b.html")
    assert urls(M.extract(n, M.img_images(retry=False)))[:1] == []
    kept = urls(M.extract(n, M.img_images(retry=True)))
    assert ("image", "https://site.example/ads/a.jpg", "src") in kept
    assert not any("icon" in k[1] for k in kept)
    assert L.image_links(n, retry=True).count() == 0  # the link leads back to the page itself


def test_rewritten_thumbnail_is_kept_beside_its_link(one_page):
    rules = RuleBook(rules=[dict(rule_id=1, ord=1, img=r"^(.*)/t/(.+)$", to="$1/f/$2", domain=None)])
    n = one_page('<a href="/view.html"><img src="/t/1.jpg"></a>')
    got = urls(M.extract(n, M.img_images(rules)))
    # relative URLs are rewritten before they are made absolute
    assert got == [("image", "https://site.example/t/1.jpg", "src"), ("image", "https://site.example/f/1.jpg", "src")]


def test_icons_and_jsonld(one_page):
    n = one_page(
        '<link rel="icon" href="/f16.png" sizes="16x16"><link rel="icon" href="/favicon.png">'
        '<link rel="apple-touch-icon" href="/touch.png"><link rel="icon" href="/s.png" sizes="32x32">'
        '<script type="application/ld+json">[{"@type":["VideoObject"],"embedUrl":"https://v.example/e.mp4","url":"x"},'
        '{"@type":"ImageObject","url":"https://v.example/i.jpg"},'
        '{"image":{"url":"https://v.example/o.jpg"}},{"image":"https://v.example/s.jpg"},'
        '{"image":["https://v.example/1.jpg",{"url":"https://v.example/2.jpg"},3,"https://v.example/4.jpg",'
        '"https://v.example/5.jpg","https://v.example/6.jpg"]},5]</script>'
        '<script type="application/ld+json">not json</script>'
    )
    icons = [u for _, u, _ in urls(M.extract(n, M.icon_images()))]
    assert icons == [f"https://site.example/{p}.png" for p in ("f16", "touch", "s")]
    ld = [(k, u.rsplit("/", 1)[1]) for k, u, _ in urls(M.extract(n, M.jsonld_media()))]
    assert ld == [
        ("video", "e.mp4"), ("image", "i.jpg"), ("image", "o.jpg"), ("image", "s.jpg"), ("image", "s.jpg"),
        ("image", "1.jpg"), ("image", "2.jpg"), ("image", "4.jpg"), ("image", "5.jpg"),
    ]


def test_all_listed_images_are_streamed(spark):
    """A JSON-LD list of any length is read to its end, by the stream and by the batch."""
    names = [f"https://v.example/{i}.jpg" for i in range(12)]
    listed = ",".join(f'"{u}"' if i % 2 else f'{{"url":"{u}"}}' for i, u in enumerate(names))
    html = f'<script type="application/ld+json">{{"@type":"Article","image":[{listed}]}}</script>'
    pages = spark.createDataFrame([(1, "https://site.example/a", html)], "page_id long, url string, html string")
    for media in (St.page_media(pages), M.extract_media(nodes(pages))):
        assert [u for _, u, source in urls(media) if source == "json-ld"] == names


def test_links_merge(one_page):
    n = one_page(
        '<a href="p.html">first</a><a href="p.html">last</a><a href="#x">no</a><a href="mailto:x">no</a>'
        '<a href="q.html"><img src="q.jpg"></a><a href="q.html">words</a><a href="q.html">later</a>'
        '<a href="h.html" hidden>no</a><link rel="canonical" href="/c"><link rel="canonical" href="/d"><a href="/c">c</a>'
    )
    got = {r["url"].rsplit("/", 1)[1]: r for r in L.extract_links(n).collect()}
    assert set(got) == {"p.html", "q.html", "c"}
    assert (got["p.html"]["text"], got["p.html"]["from_image"]) == ("last", False)
    assert (got["q.html"]["text"], got["q.html"]["priority"]) == ("words", 15.0)
    assert (got["c"]["element"], got["c"]["priority"], got["c"]["text"]) == ("canonical", 2.0, None)


def test_visibility(one_page):
    n = one_page(
        '<div class="x hidden"><a href="1">a</a><p><a href="2">b</a></p></div><a href="3" aria-hidden="true">c</a>'
        '<a href="4" style="Display: None">d</a><a href="5" style="width: 0.5em">e</a><a href="6" class="hiddenish">f</a>'
    )
    shown = n.filter("tag = 'a'").filter(is_visible()).select(F.col("attrs")["href"]).collect()
    assert [r[0] for r in shown] == ["2", "6"]  # a hidden grandparent does not count, a zero-width prefix does


def test_redirect_patterns(spark):
    rows = [
        (1, "http://a/x/", "<script>document.location='/b'; window.location.replace( '/c' )</script>"),
        (2, "http://a/x/", '<META http-equiv="Refresh" content="0; url=y.html">'),
        (3, "http://a/x/", "<p>none</p>"),
    ]
    got = L.redirects(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["page_id"], r["dst"]) for r in got] == [(1, "http://a/c"), (2, "http://a/x/y.html")]


def test_gateway(spark, one_page):
    html = (
        '<form action="/go" method="post"><input type="submit" value="I agree"><button>Terms</button></form>'
        '<button onclick="location=\'/in\'">Enter site</button><a href="/legal">I agree to the legal terms</a><a href="/x">I agree</a>'
    )
    n = one_page(html)
    got = L.gateway_candidates(n).orderBy("node_id").collect()
    assert [(r["url"], r["method"], r["score"]) for r in got] == [("/go", "POST", 100), ("/in", "GET", 100), ("/x", "GET", 100)]
    pages = spark.createDataFrame([(1, "https://site.example/a/b.html", html)], "page_id long, url string, html string")
    best = L.best_gateway(n, pages, M.extract_media(n)).collect()
    assert [(r["url"], r["score"]) for r in best] == [("/go", 100)]


def test_relatives_keep_every_row(one_page):
    n = one_page("<p><a href=x><img src=y></a></p><img src=z>")
    joined = with_relative(n, "anchor_id", {"tag": "anchor_tag"})
    assert joined.count() == n.count()
    assert joined.filter("tag = 'img' and anchor_tag = 'a'").count() == 1


def test_browser_scan_first_wins(one_page):
    n = one_page(
        '<a href="a.jpg"><img src="a.jpg" width="40" height="40"></a><img src="b.jpg" srcset="c.jpg 1x, d.jpg 2x">'
        '<img src="e.png"><img src="f.jpg" data-src="//cdn.example/g.jpg"><a href="next.html">n</a><a href="#">x</a>'
    )
    got = {r["url"]: r["source"] for r in S.scan_page(n).collect()}
    assert got == {
        BASE + "a.jpg": "a-link",  # too small as an image, then seen again as a link
        BASE + "b.jpg": "img", BASE + "d.jpg": "srcset", BASE + "f.jpg": "img", "https://cdn.example/g.jpg": "data-src",
    }
    assert {r["url"] for r in S.scan_links(n).collect()} == {BASE + "a.jpg", BASE + "next.html"}


@pytest.mark.parametrize(
    ("markup", "wanted"),
    [
        ("<a href=/gallery/><img src=t.jpg></a>", [("a", "/gallery/", None), ("img", "t.jpg", 0)]),
        ("<img src=a.jpg alt=it's><img src='/b/2.jpg'> don't", [("img", "a.jpg", None), ("img", "/b/2.jpg", None)]),
        ('<img src=a.jpg alt="x><img src="b.jpg"><img src=c.jpg>', [("img", "a.jpg", None), ("img", "c.jpg", None)]),
        ("<a href=1>x<a href=2><img src=i></a></a>", [("a", "1", None), ("a", "2", None), ("img", "i", 1)]),
        ("<a href=1/>x<img src=i/></a>", [("a", "1/", None), ("img", "i/", 0)]),
        ("1 < 2 <img src = 'x y' > </ a><img src=z", [("img", "x y", None)]),
        ("<A HREF=1><IMG SRC=2 SRC=3></A ignored='>'><img src=4>", [("a", "1", None), ("img", "2", 0), ("img", "4", None)]),
    ],
)
def test_malformed_markup(markup, wanted):
    from mediaweave.operators.scanner import scan_page

    rows = scan_page(1, "u", markup)
    assert [(r[4], r[5].get("href", r[5].get("src")), r[9]) for r in rows] == wanted


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<div><a href=x>l</a>", "<p><button><div>", "<a href=1>", "<", '<a href="', "</x ", "<b></i>", "<td><table>", "<!--", "<li><ul>", "&"],
)
def test_hostile_pages_take_linear_time(piece):
    import time

    from mediaweave.operators.scanner import scan_page

    start = time.process_time()
    scan_page(1, "u", piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 30


def test_node_rows_leave_in_small_batches():
    """Node rows are Python objects until they leave, so few wait at a time."""
    import pyarrow as pa

    from mediaweave.operators import nodes, scanner

    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["https://a.example/"] * 2, "html": ["<body>" + '<p class="x">y</p>' * 3000] * 2})
    sizes = [b.num_rows for b in scanner.scan_batches([pages], nodes._arrow_schema(), True)]
    assert max(sizes) <= 1024 and sum(sizes) == 6000
