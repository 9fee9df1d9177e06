"""Rules and site patterns as indexed tables against the folded book."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from mediaweave.operators import rules as R
from mediaweave.operators.ruleindex import RuleIndex, checked_rules
from mediaweave.plans import inputs as I

RULES = "rule_id int, ord int, name string, link string, img string, to string, res array<string>"
PATTERNS = (
    "site string, enabled boolean, domains array<string>, url_patterns array<string>, replacements array<struct<source:string,target:string>>"
)


def random_rules(rng, n):
    words = ["img", "thumb", "pics", "Small", "a", "xx", "/s/", "cdn", "large"]
    out = []
    for i in range(n):
        text = rng.choice(words) + rng.choice(["", str(rng.randrange(9)), "/", "_"])
        img = rng.choice([f"{text}(.+)", f"^(.*)/{text}/(.+)$", f"(?P<n>{text}).jpg", r"(\d+)", "(a|b)c", f"^h{i % 4}[.]ex/(.+)", "((("])
        to = rng.choice(["/full/$1", "$1#big small#", "$2x", "$&y", "$<n>", "\\1$$", ":return 1", "$9", ""])
        link = rng.choice([None, None, rf"^https?:\/\/(www\.)?h{rng.randrange(4)}\.ex\/", rf"h{rng.randrange(4)}\.ex", "(((" if rng.random() < 0.1 else None])
        res = rng.choice([[], [], ["x(.)"], ["x"]])
        out.append((i, rng.randrange(n), "r", link, img, to, res))
    return out


def random_urls(rng, n):
    parts = ["img", "thumb", "pics", "small", "a", "xx", "s", "cdn1", "large_", "12", "ac", "bc"]
    rows = []
    for _ in range(n):
        path = "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        own = rng.choice(["h0.ex", "www.h1.ex", "h2.ex", "www.www.h3.ex", "cdn.other.org"])
        rows.append((f"https://{rng.choice(['h0.ex', 'www.h2.ex', 'other.org', 'H3.EX'])}/p", f"http{rng.choice(['', 's'])}://{own}/{path}.{rng.choice(['jpg', 'PNG'])}"))
    return rows + [("https://h0.ex/", ""), ("", "img"), ("https://h0.ex/", "x")]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_index_gives_what_the_book_gives(spark, seed):
    rng = random.Random(seed)
    rules = R.index_rules(spark.createDataFrame(random_rules(rng, 60), RULES))
    urls = spark.createDataFrame(random_urls(rng, 150), "page_url string, url string").distinct()
    hosts = ["h0.ex", "ex", "www.", "other.org", "2", ""] if seed == 1 else ["h0.ex", "other", "www.h2"]
    sites = [
        (f"s{k}", True, rng.sample(hosts, 2) if k % 2 else [], rng.choice([[], [r"/img\d*/"], ["(a|b)c"], ["((("], ["THUMB", "xx"]]),
         rng.choice([[("img", "IMG")], [(r"(\w+)\.jpg", r"\g<1>.jpeg"), ("a", "$")], [("(", "x")], []]))
        for k in range(8)
    ]
    patterns = spark.createDataFrame(sites, PATTERNS).coalesce(1)
    thumbnails = [("large_", ""), ("/xx/", "/yy/")]
    book, index = R.rule_book(rules, patterns, thumbnails), RuleIndex(rules, patterns, thumbnails, chunk=2)
    folded = R.apply_rules(urls, book).select("page_url", "url", "variant")
    assert folded.count() > 50
    assert same(folded, index.hits(urls).select("page_url", "url", "variant"))
    assert same(R.match_site_patterns(urls, book), index.match_sites(urls))
    assert same(R.replace_by_site(urls, book).select("page_url", "url", "replaced_url"), index.replaced(urls))
    assert same(R.transform_image_urls(urls, book), index.transform(urls))
    reasons = {(int(r["name"])) for r in book.rejects if r["kind"] == "rule"}
    assert {r.rule_id for r in index.rejects.collect()} == reasons


def test_reasons(spark):
    got = {r.rule_id: r.reason for r in checked_rules(I.rules_table(spark)).filter("reason IS NOT NULL").collect()}
    assert got == {7: "bad img pattern", 8: "bad target", 9: "code target"}


def test_many_rules(spark):
    """The plan does not grow with the rules, and all of them are found."""
    def index(n):
        k = F.col("id").cast("string")
        rows = spark.range(n).select(
            F.col("id").cast("int").alias("rule_id"), F.col("id").cast("int").alias("ord"),
            F.when(F.col("id") % 3 == 0, F.concat(F.lit("h"), k, F.lit(".ex"))).alias("domain"), F.lit(None).cast("string").alias("link"),
            F.concat(F.lit("^(.*)/rule"), k, F.lit("/(.+)$")).alias("img"), F.concat(F.lit("$1/full"), k, F.lit("/$2")).alias("to"),
            F.array().cast("array<string>").alias("res"),
        )
        sites = spark.range(n).select(
            F.concat(F.lit("s"), "id").alias("site"), F.array(F.concat(F.lit("h"), "id", F.lit(".ex"))).alias("domains"),
            F.array(F.concat(F.lit("/site"), "id", F.lit("/"))).alias("url_patterns"),
            F.array().cast("array<struct<source:string,target:string>>").alias("replacements"),
        )
        return RuleIndex(rows, sites)

    rows = [("https://h9.ex/", f"https://c.ex/rule{n}/x.jpg") for n in (9, 10, 11, 12, 19_999, 30_000)] + [("https://p/", "https://c.ex/site19999/x")]
    urls = spark.createDataFrame(rows, "page_url string, url string")

    def length(i):
        out = io.StringIO()
        with redirect_stdout(out):
            i.hits(urls).explain()
        return len(out.getvalue().splitlines())

    small, large = index(50), index(20_000)
    got = {r.variant for r in large.hits(urls).collect()}
    assert got == {f"https://c.ex/full{n}/x.jpg" for n in (9, 10, 11, 19_999)}
    assert {r.site for r in large.match_sites(urls).collect()} == {"s9", "s19999"}
    assert length(small) == length(large)


def test_empty_tables(spark):
    rules, patterns = R.index_rules(spark.createDataFrame([], RULES)), spark.createDataFrame([], PATTERNS)
    urls = spark.createDataFrame([("https://p/", "https://h/a-300x200.jpg")], "page_url string, url string")
    index = RuleIndex(rules, patterns)
    assert [r.candidate for r in index.transform(urls).collect()] == ["https://h/a.jpg"]
    assert index.transform(urls.limit(0)).collect() == [] and index.match_sites(urls).collect() == []


def test_pieces_travel_as_hashes(spark, monkeypatch):
    """Against a large index the URLs are not sent out with each of their pieces; the hits are the same."""
    from mediaweave.operators import ruleindex

    rows = [(i, i, None, None, f"/thumb/img{i}[.]jpg$", f"/big/{i}.jpg", []) for i in range(40)]
    rules = R.index_rules(spark.createDataFrame(rows, RULES))
    urls = spark.createDataFrame([(f"https://a.example/{i % 7}", f"https://b.example/thumb/img{i}.jpg") for i in range(60)] * 2, "page_url string, url string")
    index = RuleIndex(rules)
    small = sorted(map(tuple, index.hits(urls).collect()))
    monkeypatch.setattr(ruleindex, "BROADCAST_BYTES", 0)
    hits = index.hits(urls)
    assert sorted(map(tuple, hits.collect())) == small and len(small) >= 40
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_piece" in plan and "hashpartitioning(piece" not in plan
