import json

from pyspark.sql import functions as F

from mediaweave.functions.rewrite import RuleBook, required_literal
from mediaweave.operators import rules as R
from mediaweave.operators import scan as S
from mediaweave.plans import inputs as I
from mediaweave.sources import pages as P


def book(spark):
    return R.rule_book(I.rules_table(spark), I.patterns_table(spark), I.THUMBNAILS)


def test_thumbnail_is_rewritten(spark):
    df = spark.createDataFrame(
        [("https://example.com/images/thumb/image123_thumb.jpg", "https://example.com/gallery")], "url string, page_url string"
    )
    got = [r["candidate"] for r in R.transform_image_urls(df, book(spark)).orderBy("pos").collect()]
    assert "https://example.com/images/image123.jpg" in got


def test_site_hosts_match_a_pattern(spark):
    hosts = ["artstation.com", "twitter.com", "reddit.com", "imgur.com"]
    rules = RuleBook(patterns=[dict(site=h, domains=[h], url_patterns=[], replacements=[]) for h in hosts])
    df = spark.createDataFrame([(f"https://www.{h}/x", "https://p/") for h in hosts], "url string, page_url string")
    assert {r["site"] for r in R.match_site_patterns(df, rules).collect()} == set(hosts)


def test_bad_rules_are_rejected(spark):
    rows = [r.asDict() for r in I.rules_table(spark).orderBy("ord").collect()]
    good, bad = R.check_rules(spark, rows)
    assert [r["rule_id"] for r in good] == [1, 2, 3, 4, 5, 6]
    assert {r["rule_id"]: r["reason"] for r in bad} == {7: "bad img pattern", 8: "missing group", 9: "code target"}


def test_join_gives_what_folded_rules_give(spark, sf_dir):
    urls = I.image_urls(spark, sf_dir).select("page_url", "url").distinct()
    columns = ["page_url", "url", "variant"]
    folded = R.apply_rules(urls, book(spark)).select(*columns)
    joined = R.apply_rules_by_join(urls, I.rules_table(spark), chunk=1).select(*columns)
    assert folded.count() > 0
    assert folded.exceptAll(joined).isEmpty() and joined.exceptAll(folded).isEmpty()


def test_required_literal():
    assert required_literal(r"^(.*)/thumb/(.+)_thumb[.](jpg)$") == "/thumb/"
    assert required_literal(r"example\.com/img") == "example.com/img"
    assert required_literal(r"abc|def") is None
    assert required_literal(r"^(abc|def)$") is None
    assert required_literal(r"abcd?e") == "abc"
    assert required_literal(r"abc{0,2}x") is None
    assert required_literal(r"a[xyz]*bcd") == "bcd"


def test_prefilter_changes_nothing(spark):
    patterns = [r"^(.*)/ab/(.+)$", r"x{0,1}yz(.+)", r"(q|w)(.+)", r"\d+(\.)png", r"AB[.]cd(.*)"]
    texts = ["http://h/ab/1", "http://h/yz1", "http://h/q2", "http://h/12.png", "http://h/ab.CD9", "http://h/none"]
    rules = RuleBook(rules=[dict(rule_id=i, ord=i, img=p, to="$1!", domain=None) for i, p in enumerate(patterns)])
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    hits = {r["u"]: r["h"] for r in df.select("u", F.transform(rules.global_rules("u"), lambda r: r["rule_id"]).alias("h")).collect()}
    import re

    for text in texts:
        bare = re.sub("^.*?://", "", text)
        want = [i for i, p in enumerate(patterns) if re.search(p, text, re.I) or re.search(p, bare, re.I)]
        assert hits[text] == want, text


def test_reading_rule_and_pattern_files(spark, tmp_path):
    rules = {
        "one": {"link": "^(media\\.site\\.example/", "img": "a(b)", "to": "$1", "res": "src=(x)"},
        "two": 7,
        "three": {"img": "^www\\.Other\\.example/(.+)", "to": ":return 1"},
        "four": {"img": "thumb", "to": "full", "res": ["(a)", "(b)"]},
    }
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    got = P.read_rules(spark, str(tmp_path / "rules.json")).orderBy("ord").collect()
    assert [(r["name"], r["ord"], r["domain"], r["res"]) for r in got] == [
        ("one", 0, "media.site.example", ["src=(x)"]),
        ("three", 2, "www.other.example", None),  # an escaped www. is part of the host
        ("four", 3, None, ["(a)", "(b)"]),
    ]
    listed = {"patterns": [
        {"site": "s", "domains": ["s.example"], "image_transformations": {"replace_patterns": [{"source": "a", "target": "b"}]}},
        {"site": "off", "enabled": False},
    ], "global_settings": {"common_image_patterns": {"thumbnail_transform": [{"source": "_t", "target": "_f"}]}}}
    keyed = {
        "s": {"url_patterns": ["x"], "imagus_patterns": {"photo_transform": [{"source": "1", "target": "2"}], "image": [{"source": "3", "target": "4"}]}},
        "[comment]": {"domains": ["no"]}, "global_settings": {}, "plain": {"name": "no"},
    }
    (tmp_path / "a.json").write_text(json.dumps(listed, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(keyed))
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    first = P.read_site_patterns(spark, [a]).collect()
    assert [(r["site"], r["domains"], [tuple(x) for x in r["replacements"]]) for r in first] == [("s", ["s.example"], [("a", "b")])]
    both = P.read_site_patterns(spark, [a, b]).collect()
    assert [(r["site"], r["domains"], [tuple(x) for x in r["replacements"]]) for r in both] == [("s", None, [("1", "2"), ("3", "4")])]
    assert P.read_thumbnail_patterns(spark, a) == [("_t", "_f")]


def test_browser_rules_use_the_first_that_changes(spark):
    rules = RuleBook(rules=[
        dict(rule_id=1, ord=1, link="^other", img="a(.+)", to="$1", domain=None),
        dict(rule_id=2, ord=2, link="page", img="^(http://h/)t/(\\w+)", to="$1f/$2.#jpg png#", domain=None),
        dict(rule_id=3, ord=3, link=None, img="t/(.+)", to="never", domain=None),
    ])
    df = spark.createDataFrame([("http://h/t/x9?tail", "http://page"), ("http://h/z", "http://page")], "url string, page_url string")
    got = [r[0] for r in df.select(S.first_rule(F.col("url"), F.col("page_url"), rules)).collect()]
    assert got == ["http://h/f/x9.jpg", None]


def test_discovery_on_linked_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://h.example/p1", '<meta og="http://i/x.jpg"><img src="http://i/y.jpg"><img src="//i/z.webp"><img src="http://i/w.gif">'),
            (2, "http://h.example/p2", '<img src="http://i/y.jpg">'),
        ],
        "page_id long, url string, html string",
    )
    links = spark.createDataFrame(
        [(9, "http://s/", "http://h.example/p1/", 1), (9, "http://s/", "http://h.example/p2", 2), (9, "http://s/", "http://d/k.jpg", 3)],
        "page_id long, page_url string, url string, rank int",
    )
    rules = RuleBook(rules=[dict(rule_id=1, ord=1, link="h[.]example/p1", res=['og="([^"]+)"', "none=(.)"], img="", to="", domain=None)])
    got = {r["url"]: r["source"] for r in S.discover_fullsize(links, pages, rules).collect()}
    assert got == {
        "http://i/x.jpg": "sieve-res", "http://i/y.jpg": "linked-img", "https://i/z.webp": "linked-img", "http://d/k.jpg": "link-direct",
    }
    assert [r["resolved_url"] for r in S.resolve_url(links, pages, rules).orderBy("rank").collect()] == [
        "http://i/x.jpg", "http://h.example/p2", "http://d/k.jpg",
    ]


def candidates(spark, book, url, page="https://p.example/x"):
    df = spark.createDataFrame([(url, page)], "url string, page_url string")
    return [r["candidate"] for r in R.transform_image_urls(df, book).orderBy("pos").collect()]


def rules_of(spark, rows):
    schema = "rule_id int, ord int, name string, link string, img string, to string, res array<string>"
    return R.index_rules(spark.createDataFrame(rows, schema))


def test_python_references_of_site_patterns(spark):
    pairs = [
        (r"/thumb/(\d+)\.jpg", r"/full/\1.jpg"),
        (r"/a/(?P<the_id>\d+)x", r"/b/\g<the_id>y"),
        (r"/q(\d)z", r"/r\g<1>0$"),
        ("(unclosed", "x"),
        ("/ok/", r"\7"),
    ]
    site = [("s", True, ["h.example"], ["[bad", r"h\.example/\w+"], pairs)]
    kind = "site string, enabled boolean, domains array<string>, url_patterns array<string>, replacements array<struct<source:string,target:string>>"
    book = R.rule_book(rules_of(spark, []), spark.createDataFrame(site, kind), [(r"/w(\d)/", r"/whole\1/"), ("[", "x")])
    assert candidates(spark, book, "https://h.example/thumb/9.jpg") == ["https://h.example/full/9.jpg"]
    assert candidates(spark, book, "https://h.example/a/12x") == ["https://h.example/b/12y"]
    assert candidates(spark, book, "https://h.example/q4z") == ["https://h.example/r40$"]
    assert candidates(spark, book, "https://other.example/w3/i.png") == ["https://other.example/whole3/i.png"]
    assert {(r.kind, r.name, r.reason) for r in R.rejected(spark, book).collect()} == {
        ("replacement", "s", "bad pattern"), ("replacement", "s", "missing group"), ("site pattern", "s", "bad pattern"),
        ("thumbnail", "[", "bad pattern"),
    }


def test_targets_of_rules(spark):
    rows = [
        (1, 1, "a", None, r"/t1/(\w+)", "/f/$1?$&$$", []),
        (2, 2, "b", None, r"/t2/(?P<my_name>\w+)", r"/f/\1-$<my_name>\\q", []),
        (3, 3, "c", None, r"/t3/(\w+)", "/f/$2", []),
        (4, 4, "d", None, r"/t4/\w+", "big$&", []),
        (5, 5, "e", None, r"\x2f\x74\x35\x2f(\w+)", "/f/$1", []),
        (6, 6, "f", None, "/t6/(", "x", []),
        (7, 7, "g", None, "/t7/", "$", []),
        (8, 8, "h", None, "/t8/", "$<none>", []),
    ]
    book = R.rule_book(rules_of(spark, rows))
    urls = {n: f"http://h/t{n}/abc" for n in range(1, 9)}
    got = {n: candidates(spark, book, u) for n, u in urls.items()}
    assert got[1][1:] == ["http://h/f/abc?/t1/abc$"] and got[2][1:] == ["http://h/f/abc-abc\\q"]
    assert got[4][1:] == ["http://hbig/t4/abc"] and got[5][1:] == ["http://h/f/abc"] and got[7][1:] == ["http://h$abc"]
    assert {r["name"]: r["reason"] for r in book.rejects} == {"3": "missing group", "6": "bad img pattern", "8": "bad target"}


def test_repeated_order_is_paged_whole(spark):
    rows = [(n, o, "n", None, "/x/(.+)", f"/y{n}/$1", []) for n, o in enumerate([1, 2, 2, 3])]
    urls = spark.createDataFrame([("https://p/", "http://h/x/1")], "page_url string, url string")
    for chunk in (1, 2, 3, 100):
        got = R.apply_rules_by_join(urls, rules_of(spark, rows), chunk=chunk)
        assert got.select("variant").distinct().count() == 4
    files = rules_of(spark, rows).unionByName(rules_of(spark, [(n, o, "m", None, i, t.replace("y", "z"), r) for n, o, _, _, i, t, r in rows]))
    for chunk in (1, 3):
        assert R.apply_rules_by_join(urls, files, chunk=chunk).select("variant").distinct().count() == 8


def test_one_bad_rule_does_not_stop_the_others(spark):
    rows = [(1, 1, "n", r"h\.example/", "(((", "x", []), (2, 2, "n", r"h\.example/", "/x/", "/y/", []), (3, 3, "n", None, "x", "$9", [])]
    urls = spark.createDataFrame([("https://h.example/", "http://h.example/x/1")], "page_url string, url string")
    assert [r["variant"] for r in R.apply_rules_by_join(urls, rules_of(spark, rows)).collect()] == ["http://h.example/y/1"]


def test_required_literal_against_matches():
    """No pattern is ever screened out on a text it matches."""
    import random
    import re

    rng = random.Random(0)
    parts = ["abc", "/", "\\.", "\\d", "\\x2f", "\\/", "[.]", "[\\]x]", "[a-c]", "(x|y)", "(?:ab)?", "(abc)", "+", "*", "?", "{0,2}", "{2}", "|", "img", ".", "^", "$", "\\w", "A", "\\t", "-", "[^/]"]
    texts = ["".join(rng.choice(["abc", "/", ".", "1", "x", "]", "ab", "img", "A", "a", "\t", "-", "y"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    screened = 0
    for _ in range(6000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        text = required_literal(pattern)
        if text:
            screened += 1
            for t in texts:
                assert text in t.lower() or not compiled.search(t), (pattern, text, t)
    assert screened > 100
    assert required_literal(r"^https?:\x2f\x2fimg.ex") is None and required_literal(r"[\]x]thumb-(.+)") is None


def test_first_rule_with_many_rules(spark):
    """The plan does not grow with the rules, and the first fitting one wins."""
    rules = [dict(rule_id=i, ord=i, link=None, res=[], img=f"/rule{i}/(.+)$", to=f"http://full/{i}/$1", domain=None) for i in range(3000)]
    rules.insert(0, dict(rule_id=-1, ord=-1, link="only[.]here", res=[], img="/rule7/", to="x", domain=None))
    df = spark.createDataFrame([(f"http://h/rule{n}/p.jpg", "http://page/") for n in (7, 2999, 5000)], "url string, page_url string")
    got = [r["v"] for r in df.select(S.first_rule(F.col("url"), F.col("page_url"), RuleBook(rules=rules)).alias("v")).collect()]
    assert got == ["http://full/7/p.jpg", "http://full/2999/p.jpg", None]
