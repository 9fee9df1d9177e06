"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "mediaweave") -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A private temporary folder is used only in local mode, where the driver and
    the executors share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    current = spark.sparkContext.getCheckpointDir()
    return current or tempfile.mkdtemp(prefix="mediaweave-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


_WORK = ("MapIn", "Aggregate", "Join", "Window", "Generate", "Sort", "Distinct", "Deduplicate", "Repartition")


def _node_names(plan):
    """Names of a logical plan's nodes."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node.nodeName()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]


def settled(df: DataFrame) -> DataFrame:
    """A table that several branches of a plan are about to read.

    Each branch would work out its input again, with other columns and so
    without sharing the exchange.  Anything more than a scan is therefore
    written to the checkpoint folder once; a plain scan is returned as it is.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return cut_lineage(df) if any(name.startswith(_WORK) for name in _node_names(plan)) else df
