"""One query per operator over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.llm import decontaminate as Dc
from mediaweave.llm import extract as Ex
from mediaweave.llm import language as Ln
from mediaweave.llm import licenses as Lc
from mediaweave.llm import mixing as Mx
from mediaweave.llm import neardup as Nd
from mediaweave.llm import paragraphs as Pg
from mediaweave.llm import prefixes as Px
from mediaweave.llm import quality as Ql
from mediaweave.llm import repeats as Rp
from mediaweave.llm import search as Se
from mediaweave.llm import tokens as Tk
from mediaweave.llm import warc as Wa
from mediaweave.llm.tables import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


@query("op1_quality_rules")
def _(spark, sf):
    """Line-first quality rules over every document."""
    judged = Ql.with_quality(documents(spark, sf).select("doc_id", "text"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_lost", "base_failed", "kept",
    )


@query("op3_decontamination")
def _(spark, sf):
    """Benchmark windows in every document."""
    docs = documents(spark, sf).select("doc_id", "text")
    found = Dc.scan(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_mixing")
def _(spark, sf):
    """Words that the mix takes of every document."""
    out = Mx.mix(documents(spark, sf), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op7_token_files")
def _(spark, sf):
    """Every document's place in the token files, read back from them."""
    return Tk.token_table(documents(spark, sf))


@query("op4_language_id")
def _(spark, sf):
    """Language of every document, learnt from two thirds of them."""
    docs = documents(spark, sf)
    model = Ln.train(docs.filter(~Ln.held_out()).select("text", "lang"))
    found = Ln.identify(docs.select("doc_id", "text"), model)
    out = found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
    return out.select("doc_id", Ln.held_out().alias("held_out"), "lang_pred", "score")


@query("op10_warc")
def _(spark, sf):
    """Every page's record, read back from WARC files converted from legacy archives."""
    return Wa.page_archive(spark, spark.read.parquet(f"{sf}/pages.parquet"))


@query("op2_near_duplicates")
def _(spark, sf):
    """Components of documents with like sets of two-word shingles."""
    found = Nd.near_duplicates(documents(spark, sf).select("doc_id", "text"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_paragraph_dedup")
def _(spark, sf):
    """Paragraphs that nearly repeat another one, by component, in passages of 20 words and more."""
    return Pg.duplicate_paragraphs(documents(spark, sf))


@query("op5_repeated_passages")
def _(spark, sf):
    """Passages of 50 words or more that occur more than once."""
    found = Rp.repeated_passages(documents(spark, sf))
    removed = F.aggregate("later", F.lit(0), lambda n, s: n + s.past_word - s.first_word).cast("bigint")
    return found.select("doc_id", "first_word", "past_word", removed.alias("n_words_later"))


@query("op9_license_scan")
def _(spark, sf):
    """License notices in every document."""
    return Lc.license_matches(documents(spark, sf).select("doc_id", "text"))


@query("op12_conversation_trie")
def _(spark, sf):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return Px.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op13_ranked_search")
def _(spark, sf):
    """The ten best documents for every benchmark item."""
    docs = documents(spark, sf).select("doc_id", "text")
    return Se.ranked(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op11_html_extraction")
def _(spark, sf):
    """Main text of every page."""
    found = Ex.extract(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", "n_chars")
