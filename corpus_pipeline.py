"""From raw documents to packed training tokens, stage by stage.

Each stage takes all that the one before kept, as written and read back, and its decisions take effect:
failing lines and rejected documents go, one document of each group of near copies stays, benchmark passages are
cut out, documents are repeated or left out as the mix asks, and what is left is encoded into token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaweave.llm.decontaminate import decontaminate
from mediaweave.llm.mixing import mixed_documents
from mediaweave.llm.neardup import without_near_duplicates
from mediaweave.llm.quality import clean_documents
from mediaweave.llm.tables import documents, stored
from mediaweave.llm.tokens import token_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; a row per document as read back."""
    return token_table(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: Components of links, dependent rounding and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
