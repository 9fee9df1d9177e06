"""Main text extraction: layouts, markup, cuts, odd rows."""

import itertools
import random
import time

import odd_rows as odd
import pytest

from mediaweave.llm import extract, mincut
from mediaweave.llm.extract import main_text

P = "The river rose all night, and by the morning the lower fields were under water. Nobody had seen it so high."
Q = "Buy two boats today and pay for one only, in all shops of the valley and on the coast, as long as there are any."


def joined(*blocks):
    return "\n\n".join(blocks)


LAYOUTS = {
    "article": (
        f'<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- {Q} --><div class="ad">{Q}</div><article><h1>Flood</h1><p><b>{P}<br>'
        f"<p>Yes.</p><p>{P}</p></article><footer>&copy; site &middot; {Q}</footer>",
        joined("Flood", P, "Yes.", P),
    ),
    "classes": (
        f'<div id="header"><a href="/">Site</a></div><div class="menu"><a href="a">Home</a> <a href="b">About</a></div><div class="content"><h1>Flood</h1>'
        f'<p>{P}</p><p>Yes.</p></div><div class="sidebar-left"><h3>More</h3><p>{Q}</p></div><div id="comments"><div class="comment"><p>{Q}</p></div></div>'
        f'<div class="cookiebar"><p>{Q}</p></div><div class="site-footer"><p>{Q}</p></div>',
        joined("Flood", P, "Yes."),
    ),
    "no names": (
        f'<div><div><a href="a">Home</a> | <a href="b">About</a></div><div><h1>Flood</h1><div>{P}</div><div>Short one</div><div>{P}</div></div>'
        "<div>Copyright (c) 2020 Site</div></div>",
        joined("Flood", P, "Short one", P),
    ),
    "things in the article": (
        f'<main><article><header><h1>Flood</h1></header><p>{P}</p><aside><p>{Q}</p></aside><div class="advert-box">{Q}</div><ul><li>One thing</li>'
        f'<li>Other thing</li></ul><form><label>Mail</label><button>Send</button></form><p>End.</p><section class="comments"><article><p>{Q}</p></article>'
        f'</section></article></main><div class="cookie-notice"><p>{Q}</p></div>',
        joined("Flood", P, "One thing", "Other thing", "End."),
    ),
    "form around all": (f'<form id="f"><header><nav><a>x</a></nav></header><main><h1>T</h1><p>{P}</p></main></form>', joined("T", P)),
    "after the article": (f"<article><h1>T</h1><p>{P}</p></article><section><h2>Said</h2><p>{Q}</p></section>tail", joined("T", P)),
    "roles": (
        f'<div role="main"><h1>T</h1><p>{P}</p></div><div role="complementary"><p>{Q}</p></div><section id="reader-comments"><p>{Q}</p></section>',
        joined("T", P),
    ),
    "table": (f'<table><tr><td><a href="1">One</a><br><a href="2">Two</a></td><td>{P}<br><br>{P}</td></tr></table>', f"{P} {P}"),
    "nothing but boilerplate": ('<nav><a href="a">Home</a></nav><footer>&copy; 2020</footer>', ""),
    "no markup": (P, P),
    "unseen": (
        f'<head><title>{Q}</title><style>p {{}}</style></head><article><script>"<p>{Q}</p>"</script><noscript><p>{Q}</p></noscript><template><p>{Q}</p>'
        f'</template><p hidden>{Q}</p><div style="display: none"><p>{Q}</p></div><textarea>{Q}</textarea><p>{P}</p></article>',
        P,
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert main_text(page) == want
    assert main_text(f"<!DOCTYPE html><html><body class='has-sidebar'>{page}</body></html>") == want


def test_markup():
    def text(inner):
        return main_text(f"<article>{inner}</article>")

    assert text("<p>a &lt;b&gt; &amp;amp; &#233; &hellip; x&nbsp;y &bogus; &am &amp") == "a <b> &amp; é … x y &bogus; &am &"
    assert text("<p>one<b>two</b> three <i>four<p>five</i> six") == joined("onetwo three four", "five six")
    assert text("<p> a \n\t b<br/>c <!-- x --> d <!> e<P>f</p>") == joined("a b c d e", "f")
    assert text("<ul><li>a b<li>c d</ul><dl><dt>e f<dd>g h</dl>") == joined("a b", "c d", "e f", "g h")
    assert text("<p>1 < 2 > 0 and a</p><p title='>'>b <x-y z=\">\">c</x-y></p>") == joined("1 < 2 > 0 and a", "b c")
    assert text("<p>\U0001f600 中文</p><p>\x00</p>") == joined("\U0001f600 中文", "\x00")
    assert text("<p>x</p></b></div></p></body>") == "x"


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in (
        "<b>" * 50_000 + "x", "<p><b>" * 40_000, "<div>" * 50_000, "<div><i>" * 20_000 + "</i>" * 20_000, "<" * 200_000, "<!--" * 50_000,
        '<a b="' * 30_000, "<script>" * 50_000, f"<p>{P}</p><div class=ad>{P}</div>" * 3000, "<div>word here</div>" * 6000 + f"<p>{P}</p>",
        "<a " + 'x="1" ' * 50_000 + ">",
    ):
        main_text(page)
    assert time.time() - began < 30


def test_cuts_are_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        terminals = [rng.randrange(-20, 21) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(12)) for _ in range(rng.randrange(12))]

        def cost(side):
            cut = sum(c for a, b, c in edges if side[a] != side[b])
            return cut + sum(abs(t) for t, s in zip(terminals, side) if (t > 0) != s and t)

        least = min(cost(side) for side in itertools.product([True, False], repeat=n))
        assert cost(mincut.source_side(terminals, edges)) == least


def test_rows(spark):
    kind = "page_id long, url string, html string, row string, text string, n_chars string, _html string"
    long_page = "<article>" + f"<p>{P}</p>" * 3000 + "</article>"
    pages = [None, "", "  \n", "<p>", LAYOUTS["article"][0], LAYOUTS["article"][0], long_page, None]
    rows = [(k if k < 7 else None, "u", page, "r", "t", "n", "h") for k, page in enumerate(pages)]
    rows.append(rows[4])
    got = extract.extract(spark.createDataFrame(rows, kind))
    assert got.columns == ["row", "text", "n_chars"]
    found = sorted((r.row.page_id if r.row.page_id is not None else -1, r.row.text, r.text, r.n_chars) for r in got.collect())
    want = LAYOUTS["article"][1]
    texts = ["", "", "", "", "", want, want, want, joined(*[P] * 3000)]
    ids = [-1, 0, 1, 2, 3, 4, 4, 5, 6]
    assert found == [(i, "t", t, len(t)) for i, t in zip(ids, texts)]
    assert extract.extract(spark.createDataFrame([], kind)).collect() == []
    assert extract.extract(odd.table(spark).selectExpr("doc_id AS page_id", "lang AS url", "text AS html")).count() == 15


def test_given_pages(spark, sf_dir):
    """The given pages have one layout: an article of a heading and paragraphs between boilerplate."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in extract.extract(pages.withColumn("page", pages.html)).collect():
        inner = r.row.page.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == joined(*(b for b in blocks if b))
