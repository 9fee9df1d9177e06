"""Shared folder, written tables and input readers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.session import checkpoint_folder

#: ASCII white space: the separators of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share."""
    return f"{checkpoint_folder(spark)}/mediaweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["_stored_at"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_list(text: Column | str) -> Column:
    """Words of a text; none for null."""
    parts = F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), f"{SPACE}+")
    return F.array_compact(F.transform(parts, lambda w: F.nullif(w, F.lit(""))))


def word_count(text: Column | str) -> Column:
    text = text if isinstance(text, Column) else F.col(text)
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
