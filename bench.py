"""Bench of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query is run to the end with its rows discarded; the best of the runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from mediaweave.functions.rewrite import RuleBook  # noqa: E402
from mediaweave.operators import health as H  # noqa: E402
from mediaweave.operators import manifest as Mf  # noqa: E402
from mediaweave.operators import media as M  # noqa: E402
from mediaweave.operators import rules as R  # noqa: E402
from mediaweave.operators.ruleindex import RuleIndex  # noqa: E402
from mediaweave.operators import scan as S  # noqa: E402
from mediaweave.operators.nodes import nodes  # noqa: E402
from mediaweave.plans import queries as Q  # noqa: E402
from mediaweave.session import cut_lineage, local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

REGISTERED = [
    "q00_top_link_hosts", "h01_node_counts", "f01_extract_media", "f02_extract_links", "h24_scan_page",
    "j02_json_media", "r09_transform_image_url", "r11_discover_fullsize", "k01_url_priority", "k06_first_wins",
    "k09_unique_names", "k10_politeness_waves", "a04_pattern_scores", "a06_host_health", "f04_filter_links", "c01_crawl",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(build) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run(build())
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def many_rules(n: int = 849) -> RuleBook:
    """Two thirds bound to a host, one third global."""
    rules = [
        dict(
            rule_id=i, ord=i, link=None, res=[],
            img=rf"^(.*)/rule{i}/(.+)[.](jpg|png)$", to=f"$1/full{i}/$2.$3",
            domain=f"h{i}.example.com" if i % 3 else None,
        )
        for i in range(n)
    ]
    return RuleBook(rules=rules)


def plain_health(log):
    """The same score with one window per host, to compare the bucketed fold with."""
    from pyspark.sql import Window as W

    w = W.partitionBy("host").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    s = log.withColumn("s", F.sum(H.health_step()).over(w))
    f = s.withColumn("f", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    return f.groupBy("host").agg(F.max("f"))


def main() -> None:
    spark = local_session(CPUS, "bench")
    run(Q.QUERIES["q00_top_link_hosts"](spark, SF_DIR))  # start the workers
    queries, rates = {}, {}
    for name in REGISTERED:
        queries[name] = best(lambda: Q.QUERIES[name](spark, SF_DIR))

    pages = Q.media_pages(spark, SF_DIR)
    n_pages = pages.count()

    def pages_to_manifest(node_table):
        return Mf.to_manifest(Mf.with_route(Mf.first_wins(M.extract_media(node_table))))

    queries["pages_to_manifest_cold"] = best(lambda: pages_to_manifest(nodes(pages, marked_only=True)))
    folder = tempfile.mkdtemp(prefix="bench-") + "/nodes"
    nodes(pages, marked_only=True).write.parquet(folder)
    queries["pages_to_manifest_stored_nodes"] = best(lambda: pages_to_manifest(spark.read.parquet(folder)))
    rates["pages_per_sec_cold"] = round(n_pages / queries["pages_to_manifest_cold"])
    rates["pages_per_sec_stored_nodes"] = round(n_pages / queries["pages_to_manifest_stored_nodes"])

    urls = Q.corpus(spark, SF_DIR).select(F.col("base").alias("page_url"), "url")
    n_urls = urls.count()
    rules = many_rules()
    queries["rewrite_849_rules"] = best(lambda: R.transform_image_urls(urls, rules))
    rates["urls_per_sec_849_rules"] = round(n_urls / queries["rewrite_849_rules"])

    # the given URLs in fifty versions each, so that work and not planning is measured
    many = urls.select("page_url", "url", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("v"))
    many = cut_lineage(many.select("page_url", F.concat("url", F.lit("?v="), F.col("v").cast("string")).alias("url")).repartition(4 * int(CPUS)))
    n_many = many.count()
    for k in (849, 20_000):
        fields = "rule_id int, ord int, domain string, link string, img string, to string, res array<string>"
        table = spark.createDataFrame([{n: r[n] for n in ("rule_id", "ord", "domain", "link", "img", "to", "res")} for r in many_rules(k).rules], fields)
        index = RuleIndex(table)
        queries[f"rewrite_{k}_rules_indexed"] = best(lambda: index.transform(many))
        rates[f"urls_per_sec_{k}_rules_indexed"] = round(n_many / queries[f"rewrite_{k}_rules_indexed"])

    for k in (849, 5000):
        rules = many_rules(k)
        first = F.col("url"), F.col("page_url"), rules
        queries[f"first_rule_{k}_rules"] = best(lambda: urls.withColumn("v", S.first_rule(*first)))
        rates[f"urls_per_sec_first_rule_{k}"] = round(n_urls / queries[f"first_rule_{k}_rules"])

    log = H.outcomes(Q.fetches(spark, SF_DIR))
    n_events = log.count()
    queries["health_bucketed"] = best(lambda: H.host_health(log))
    queries["health_plain_window"] = best(lambda: plain_health(log))
    rates["events_per_sec_bucketed"] = round(n_events / queries["health_bucketed"])
    rates["events_per_sec_plain_window"] = round(n_events / queries["health_plain_window"])
    rates["crawl_sec_per_round"] = round(queries["c01_crawl"] / 3, 3)

    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "rates": rates,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
