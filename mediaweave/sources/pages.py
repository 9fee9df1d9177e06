"""Reading pages, bytes, lists, patterns and rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.operators.health import fetch_status
from mediaweave.operators.rules import index_rules


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Pages with one HTML text per URL.

    A few large files give too few splits for the scan of the markup; then the
    rows are spread by page once.  At cluster size the splits outnumber the
    cores and the pages are read where they lie.
    """
    return spread(spark.read.parquet(path), partitions)


def spread(df: DataFrame, wanted: int | None = None, key: str = "page_id", rows: int | None = None) -> DataFrame:
    """Spread rows by key when the input has fewer splits than cores; else leave them where they lie.

    With ``rows``, also when a split would hold more rows than that, so that the longest task does not grow with the table.
    """
    wanted = wanted or df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= wanted else df.repartition(wanted, key)


def with_status(pages: DataFrame) -> DataFrame:
    """Status of each fetch: an HTTP class, or a body that is missing."""
    status = fetch_status("status") if "status" in pages.columns else F.lit("SUCCESS")
    missing = F.col("html").isNull() & (status == "SUCCESS")
    return pages.withColumn("error_status", F.when(missing, "NETWORK_ERROR").otherwise(status))


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw page files: their path as URL and their bytes, decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("url"), "content", decode_bytes(F.col("content")).alias("html"))


def charset_of(content: Column) -> Column:
    """Byte order mark, else the charset the first 2,048 bytes declare, else UTF-8."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"""(?i)charset\s*=\s*["']?([a-z0-9_\-]+)""", 1))
    start = F.hex(F.substring(content, 1, 3))
    return (
        F.when(start == "EFBBBF", "UTF-8-SIG")
        .when(start.startswith("FFFE") | start.startswith("FEFF"), "UTF-16")
        .when(declared.isin("", "utf-8", "utf8"), "UTF-8")
        .otherwise(declared)
    )


def _decode_declared(content: Column, charset: Column) -> Column:
    """Pages in other charsets; an unknown charset is read as UTF-8.

    The built-in ``decode`` knows few charsets and fails the job on a bad byte.
    """

    @F.pandas_udf("string")
    def decode(raw: pd.Series, names: pd.Series) -> pd.Series:
        def one(data, name):
            if data is None:
                return None
            try:
                return data.decode(name, errors="replace")
            except LookupError:
                return data.decode("utf-8", errors="replace")

        return pd.Series([one(data, name) for data, name in zip(raw, names)], dtype=object)

    return decode(content, charset)


def decode_bytes(content: Column) -> Column:
    """Page text; bytes that do not fit the charset become the replacement character.

    UTF-8, nearly all of a crawl, is decoded on the JVM; only pages in other
    charsets send their bytes to Python.
    """
    found = charset_of(content)
    other = ~found.isin("UTF-8", "UTF-8-SIG")
    return (
        F.when(found == "UTF-8", F.make_valid_utf8(content.cast("string")))
        .when(found == "UTF-8-SIG", F.make_valid_utf8(F.substring(content, 4, 2147483647).cast("string")))
        .otherwise(_decode_declared(F.when(other, content), found))
    )


def parse_blocklist(lines: DataFrame) -> DataFrame:
    """Hosts of a ``value`` column, one per line; blank lines and ``#`` comments are dropped."""
    line = F.trim("value")
    hosts = lines.select(line.alias("host"))
    return hosts.filter((F.col("host") != "") & ~F.col("host").startswith("#")).distinct()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocklist(spark.read.text(path))


_PATTERN = (
    "site string, enabled boolean, domains array<string>, url_patterns array<string>, "
    "image_transformations struct<replace_patterns:array<struct<source:string,target:string>>>, "
    "imagus_patterns struct<photo_transform:array<struct<source:string,target:string>>,"
    "media:array<struct<source:string,target:string>>,image:array<struct<source:string,target:string>>>"
)


def parse_site_patterns(files: DataFrame) -> DataFrame:
    """Site patterns of pattern files (``file`` number, ``value`` text).

    A file holds either ``patterns`` as a list, or one keyed object per site; a
    later file replaces a site of an earlier one.
    """
    pair = "array<struct<source:string,target:string>>"
    texts = files.select("file", F.from_json("value", "map<string,string>").alias("f"))
    listed = texts.filter(F.col("f")["patterns"].isNotNull()).select(
        "file",
        F.posexplode(F.from_json(F.col("f")["patterns"], "array<string>")).alias("pos", "raw"),
        F.lit(None).cast("string").alias("key"),
    )
    keyed = texts.filter(F.col("f")["patterns"].isNull()).select(
        "file", F.posexplode(F.map_entries("f")).alias("pos", "e")
    )
    keyed = keyed.select("file", "pos", F.col("e.value").alias("raw"), F.col("e.key").alias("key"))
    keyed = keyed.filter((F.col("key") != "global_settings") & ~F.col("key").startswith("["))
    rows = listed.unionByName(keyed)
    parsed = rows.filter(F.trim("raw").startswith("{")).withColumn("p", F.from_json("raw", _PATTERN))
    named = parsed.withColumn("site", F.coalesce("p.site", "key"))
    usable = named.filter(
        F.when(F.col("key").isNull(), F.col("p.site").isNotNull() & F.coalesce("p.enabled", F.lit(True))).otherwise(
            F.col("p.site").isNotNull() | F.col("p.domains").isNotNull() | F.col("p.url_patterns").isNotNull()
        )
    )
    none = F.array().cast(pair)
    lists = [F.coalesce(F.col("p.imagus_patterns")[n], none) for n in ("photo_transform", "media", "image")]
    replacements = F.when(
        F.col("p.image_transformations").isNotNull(),
        F.coalesce(F.col("p.image_transformations.replace_patterns"), none),
    ).otherwise(F.concat(*lists))
    last = usable.withColumn("replacements", replacements).groupBy("site").agg(
        F.max_by(
            F.struct("p.domains", "p.url_patterns", "replacements"), F.struct("file", "pos")
        ).alias("p")
    )
    kept = F.filter("p.replacements", lambda r: (r["source"] != "") & (r["target"] != ""))
    return last.select("site", F.lit(True).alias("enabled"), "p.domains", "p.url_patterns", kept.alias("replacements"))


def read_site_patterns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Site patterns of files in order of precedence."""
    files = None
    for n, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).withColumn("file", F.lit(n))
        files = one if files is None else files.unionByName(one)
    return parse_site_patterns(files)


def read_thumbnail_patterns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Thumbnail replacements of a pattern file's global settings, in order."""
    kind = (
        "global_settings struct<common_image_patterns:struct<thumbnail_transform:"
        "array<struct<source:string,target:string>>>>"
    )
    row = spark.read.text(path, wholetext=True).select(
        F.from_json("value", kind)["global_settings"]["common_image_patterns"]["thumbnail_transform"].alias("t")
    ).first()
    return [(p["source"], p["target"]) for p in (row["t"] or []) if p["source"] and p["target"]] if row else []


def parse_rules(files: DataFrame) -> DataFrame:
    """Rewrite rules of a rule file's text, in file order; entries that are not objects are skipped."""
    texts = files.select(F.from_json("value", "map<string,string>").alias("f"))
    rows = texts.select(F.posexplode(F.map_entries("f")).alias("ord", "e"))
    rows = rows.filter(F.trim("e.value").startswith("{")).withColumn(
        "r", F.from_json("e.value", "link string, img string, to string, res string")
    )
    res = F.col("r.res")
    as_list = F.when(F.trim(res).startswith('["'), F.from_json(res, "array<string>")).when(
        F.coalesce(res, F.lit("")) != "", F.array(res)
    )
    return index_rules(
        rows.select(
            F.col("ord").alias("rule_id"),
            "ord",
            F.col("e.key").alias("name"),
            F.col("r.link").alias("link"),
            F.col("r.img").alias("img"),
            F.col("r.to").alias("to"),
            as_list.alias("res"),
        )
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.text(path, wholetext=True))
