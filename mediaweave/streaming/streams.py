"""Streaming forms of the page, media, health and progress operators."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave import constants as K
from mediaweave.functions import urls as U
from mediaweave.functions.rewrite import RuleBook
from mediaweave.operators import health as H
from mediaweave.operators import media as M
from mediaweave.operators.nodes import nodes
from mediaweave.operators.ordered import SLICE, slices

PAGE_SCHEMA = "page_id bigint, url string, html string, fetched_at timestamp"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, only: str = "*") -> DataFrame:
    """Stream of Parquet files arriving in a folder; ``only`` picks them by name."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a stored table, ``name.parquet`` in ``folder``, be it one file or a folder of files.

    A stream's path must be a folder or a pattern; a pattern for the last letter stands for either.
    """
    return read_stream(spark, f"{folder}/{name}.parque[t]", schema, files_per_batch)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; files may hold a local one."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def page_media(pages: DataFrame, rules: RuleBook | None = None) -> DataFrame:
    """Media of arriving pages (stateless)."""
    return M.extract_media(nodes(pages, marked_only=True), rules)


def distinct_media(media: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """First sighting of each normalised URL within the watermark delay, which bounds the state."""
    keyed = media.withColumn("norm_url", U.normalize_url("url"))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["norm_url"])


def host_media(media: DataFrame) -> DataFrame:
    """Running number of media per host of the page (update mode)."""
    return media.groupBy(U.get_domain("page_url").alias("host")).agg(F.count("*").cast("double").alias("host_score"))


def progress_windows(fetches: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Fetches and successes per window of event time."""
    return (
        fetches.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("success")).alias("n_ok"))
        .select(F.col("w.start").alias("window_start"), "n", "n_ok")
    )


def run_available(df: DataFrame, checkpoint: str, mode: str = "append", **sink):
    """Process everything that has arrived, then stop; a restart goes on where it stopped."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if "batch" in sink:
        writer = writer.foreachBatch(sink["batch"])
    elif "path" in sink:
        writer = writer.format("parquet").option("path", sink["path"])
    else:
        writer = writer.format("memory").queryName(sink["name"])
    query = writer.start()
    query.awaitTermination()
    return query


def run_until_idle(
    df: DataFrame, checkpoint: str, path: str, idle: float = K.IDLE_SECONDS, mode: str = "append", poll: float = 0.2,
    after_batch: Callable[[int], None] | None = None,
) -> list[dict]:
    """Run a stream that ends by itself once nothing has arrived for ``idle`` seconds and all of it is written.

    Idle time counts from the end of the last batch that read rows.  Returns a row per such batch: batch, rows, seconds.
    ``after_batch`` is told the number of batches after each.
    """
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", path).start()
    batches: dict[int, dict] = {}
    last = time.monotonic()

    def look() -> bool:
        """Whether a batch has read rows since the last look."""
        new = {p["batchId"]: p for p in query.recentProgress if p["numInputRows"] and p["batchId"] not in batches}
        for n, p in sorted(new.items()):
            batches[n] = {"batch": n, "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000}
            if after_batch:
                after_batch(len(batches))
        return bool(new)

    try:
        while query.isActive:
            busy = look() or query.status["isTriggerActive"] and query.status["isDataAvailable"]
            if busy:
                last = time.monotonic()
            elif time.monotonic() - last >= idle:
                query.processAllAvailable()  # what came in the meantime is not left behind
                if not look():
                    break
                last = time.monotonic()
            time.sleep(poll)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return [batches[n] for n in sorted(batches)]


HEALTH_STATE = "host string, failures bigint, total bigint, quarantined_at timestamp, waiting bigint, last_ts timestamp"


class HealthStream:
    """Host health over micro-batches, with quarantine, probation and release.

    State is a table per batch in a shared folder: batch n reads the state of
    the batch before it and writes its own, so a repeated batch gives the same
    result.  Within a batch the score is the bucketed fold, so a host with a
    third of all fetches is not handled by one task.  A quarantined host is
    released, with its score reset, when a batch begins ``release_after`` later.
    """

    def __init__(self, spark: SparkSession, folder: str, release_after: dt.timedelta, limit: int = K.QUARANTINE_FAILURES):
        self.spark, self.folder, self.limit = spark, folder, limit
        self.release_seconds = release_after.total_seconds()

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch={batch}"

    def state(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], HEALTH_STATE)
        return self.spark.read.schema(HEALTH_STATE).parquet(self._path(batch))

    def latest(self) -> DataFrame:
        """State after the last batch that was written, whichever run wrote it."""
        every = self.spark.read.schema(HEALTH_STATE + ", batch bigint").parquet(self.folder)
        last = every.agg(F.max("batch").alias("b")).first()["b"]
        return self.state(-1 if last is None else last)

    def __call__(self, fetches: DataFrame, batch: int) -> None:
        before = self.state(batch - 1)
        start = fetches.agg(F.min("ts")).scalar()
        released = F.col("quarantined_at").isNotNull() & (
            start.cast("double") - F.col("quarantined_at").cast("double") >= self.release_seconds
        )
        ready = before.select(
            "host",
            F.when(released, F.lit(0)).otherwise(F.col("failures")).alias("failures0"),
            F.col("total").alias("total0"),
            F.when(~released, F.col("quarantined_at")).alias("quarantined0"),
            F.when(released, F.lit(0)).otherwise(F.col("waiting")).alias("waiting0"),
            F.col("last_ts").alias("last0"),
        )
        held = ready.filter(F.col("quarantined0").isNotNull()).select("host")
        aside = H.set_aside(fetches, held).groupBy("host").agg(F.count("*").alias("n_aside"))
        served = H.still_served(fetches, held)

        # the score so far enters the fold as one step in front of the batch
        carried = ready.filter((F.col("failures0") > 0) & F.col("quarantined0").isNull()).select(
            "host", F.lit("1900-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"),
            F.col("failures0").alias("step"),
        )
        steps = served.select("host", "ts", "event_id", H.health_step().cast("bigint").alias("step")).unionByName(carried)
        cut = slices(steps, ["ts", "event_id"])
        runs = H.floored_sum(cut, ["host"], F.col(SLICE), ["ts", "event_id"], F.col("step"), "failures")
        order = F.struct("ts", "event_id")
        at_limit = F.when(F.col("failures") >= self.limit, order)
        real = F.col("event_id") >= 0
        batch_state = runs.groupBy("host").agg(
            F.min(at_limit).alias("q"),
            F.min_by("failures", at_limit).alias("f_q"),
            F.max_by("failures", order).alias("f_last"),
            F.count_if(real).alias("n"),
            F.max(F.when(real, F.col("ts"))).alias("last_ts"),
        )
        tried = runs.join(batch_state.select("host", "q"), "host").groupBy("host").agg(
            F.count_if(real & (F.col("q").isNull() | (order <= F.col("q")))).alias("tried")
        )
        after = (
            ready.join(batch_state, "host", "full_outer")
            .join(tried, "host", "left")
            .join(aside, "host", "left")
            .select(
                "host",
                F.coalesce("f_q", "f_last", "failures0", F.lit(0)).cast("bigint").alias("failures"),
                (F.coalesce("total0", F.lit(0)) + F.coalesce("tried", F.lit(0))).cast("bigint").alias("total"),
                F.coalesce("q.ts", "quarantined0").alias("quarantined_at"),
                (
                    F.coalesce("waiting0", F.lit(0)) + F.coalesce("n_aside", F.lit(0))
                    + F.coalesce(F.col("n") - F.col("tried"), F.lit(0))
                ).cast("bigint").alias("waiting"),
                F.greatest("last0", "last_ts").alias("last_ts"),
            )
        )
        after.write.mode("overwrite").parquet(self._path(batch))

    def run(self, fetches: DataFrame, checkpoint: str):
        return run_available(fetches, checkpoint, "append", batch=self)
