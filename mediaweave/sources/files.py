"""Writing and reading task files and crawl state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave import constants as K
from mediaweave.operators.tasks import export_rows

BOM = "﻿"
TASK_SCHEMA = (
    "id string, url string, settings map<string,string>, download_path string, one_shot boolean, status string, "
    "stats map<string,bigint>, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp"
)


def export_tasks_csv(tasks: DataFrame, path: str) -> None:
    """Ten-column CSV, UTF-8 with a byte order mark in front of each part's header."""
    rows = export_rows(tasks)
    renamed = rows.withColumnRenamed(K.CSV_COLUMNS[0], BOM + K.CSV_COLUMNS[0])
    renamed.write.mode("overwrite").option("escape", '"').csv(path, header=True, emptyValue="")


def read_tasks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an exported file; every column is text."""
    rows = spark.read.option("escape", '"').csv(path, header=True, multiLine=True)
    return rows.toDF(*[c.removeprefix(BOM) for c in rows.columns])


def write_tasks_json(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_tasks_json(spark: SparkSession, path: str) -> DataFrame:
    """Saved tasks; those that were running come back paused."""
    saved = spark.read.schema(TASK_SCHEMA).json(path)
    status = F.coalesce("status", F.lit("queued"))
    return saved.withColumn("status", F.when(status == "running", "paused").otherwise(status))


STATE_TABLES = ("frontier", "manifest", "quarantine", "visited", "health")


def save_state(tables: dict[str, DataFrame], folder: str, round_no: int) -> None:
    """One Parquet table per kind, in a folder of its own per round."""
    for name, df in tables.items():
        if name not in STATE_TABLES:
            raise ValueError(f"unknown state table {name}")
        df.write.mode("overwrite").parquet(f"{folder}/round={round_no}/{name}")


def load_state(spark: SparkSession, folder: str, round_no: int) -> dict[str, DataFrame]:
    """Tables of a saved round, as they were: frontier rows keep their score and
    pending downloads are not compared with the URLs already seen."""
    out = {}
    for name in STATE_TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/round={round_no}/{name}")
        except Exception as e:  # a round need not have every table
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        if name not in STATE_TABLES:
            raise ValueError(f"unknown state table {name}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_snapshot(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """All state tables under a version, which counts only once its marker, the last thing written, is there."""
    missing = set(STATE_TABLES) - set(tables)
    if missing:
        raise ValueError(f"missing state tables {sorted(missing)}")
    path = f"{folder}/version={version}"
    write_tables(tables, path)
    spark = tables["frontier"].sparkSession
    spark.createDataFrame([(version, list(STATE_TABLES))], "version long, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/complete")


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Versions that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/complete/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getParent().getName().removeprefix("version=")) for f in found)


def load_snapshot(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """The last whole version and its tables; versions that were not finished are passed over."""
    versions = snapshots(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no whole snapshot in {folder}")
    return versions[-1], {name: spark.read.parquet(f"{folder}/version={versions[-1]}/{name}") for name in STATE_TABLES}
