"""Fetch results: outcomes, host health, quarantine, limits and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave import constants as K
from mediaweave.functions import urls as U
from mediaweave.operators.ordered import SLICE, floored_sum, running_rank, slices


def fetch_status(status) -> Column:
    """Status class of a page fetch; rate limiting counts as a client error."""
    s = U.col(status)
    return (
        F.when(s.isNull(), "NETWORK_ERROR")
        .when((s >= 400) & (s < 500), "HTTP_ERROR_4XX")
        .when((s >= 500) & (s < 600), "HTTP_ERROR_5XX")
        .otherwise("SUCCESS")
    )


def is_rate_limited(status) -> Column:
    return U.col(status) == 429


def fetch_error(actual_length=None) -> Column:
    """Reason a download was refused or failed, NULL when it succeeded.

    Needs url, media_type, status, content_type and content_length.  The header
    checks only apply when the header request itself succeeded.
    """
    low, size = F.lower("url"), F.col("content_length")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    answered = F.coalesce(F.col("status") < 400, F.lit(False))
    minimum = F.when(F.col("media_type") == "image", K.MIN_IMAGE_KB).otherwise(K.MIN_VIDEO_KB)
    small = answered & (size > 0) & (size / 1024 < minimum)
    too_small = F.concat(
        F.lit("File too small ("), F.format_string("%.2f", size / 1024), F.lit("KB < "),
        minimum.cast("string"), F.lit("KB)"),
    )
    out = (
        F.when(U.is_trash_media("url"), "Filtered as trash media (GIF/ICO/SVG)")
        .when(U.path_ends(low, K.NOT_DOWNLOADABLE_EXTENSIONS), "Non-media file based on URL extension")
        .when(
            answered & kind.rlike(U.any_of(K.NOT_MEDIA_CONTENT_TYPES)),
            F.concat(F.lit("Webpage/script content (Content-Type: "), kind, F.lit(")")),
        )
        .when(small, too_small)
        .when(F.col("status").isNull(), "Network error")
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP error: "), F.col("status").cast("string")))
    )
    if actual_length is not None:
        got = U.col(actual_length)
        out = out.when(
            (size > 0) & (got != size),
            F.concat(F.lit("Size mismatch: expected "), size.cast("string"), F.lit(", got "), got.cast("string")),
        )
    return out


def is_content_skip(error) -> Column:
    """Refusals that say nothing about the host."""
    return F.coalesce(F.lower(U.col(error)).rlike(U.any_of(K.CONTENT_SKIP_REASONS)), F.lit(False))


def outcomes(fetch_log: DataFrame) -> DataFrame:
    """Add error, success and content_skip to each fetch."""
    return (
        fetch_log.withColumn("error", F.explode(F.array(fetch_error())))
        .withColumn("success", F.col("error").isNull())
        .withColumn("content_skip", is_content_skip("error"))
    )


def health_step() -> Column:
    """+1 for a failure of the host, -1 for a success, 0 for a content skip."""
    return F.when(F.col("success"), -1).when(F.col("content_skip"), 0).otherwise(1)


def health_runs(fetches: DataFrame, key: str = "host") -> DataFrame:
    """Running failure score and attempt number of each fetch, in time order."""
    order = ["ts", "event_id"]
    cut = slices(fetches, order)
    return floored_sum(cut, [key], F.col(SLICE), order, health_step(), "failures", "attempt").drop(SLICE)


def host_health(fetches: DataFrame, key: str = "host", limit: int = K.QUARANTINE_FAILURES) -> DataFrame:
    """Failures, attempts and quarantine time per host.

    A host stops being tried when its score first reaches the limit, so its
    counters stand as they were at that moment.
    """
    runs = health_runs(fetches, key)
    order = F.struct("ts", "event_id")
    at_limit = F.when(F.col("failures") >= limit, order)
    state = F.struct("failures", "attempt")
    grouped = runs.groupBy(key).agg(
        F.min(at_limit).alias("q"), F.min_by(state, at_limit).alias("at_q"), F.max_by(state, order).alias("last")
    )
    stand = F.coalesce("at_q", "last")
    return grouped.select(
        key,
        stand["failures"].alias("failures"),
        stand["attempt"].alias("total"),
        F.col("q.ts").alias("quarantined_at"),
    )


def quarantined(health: DataFrame, key: str = "host") -> DataFrame:
    return health.filter(F.col("quarantined_at").isNotNull()).select(key)


def set_aside(items: DataFrame, hosts: DataFrame, key: str = "host") -> DataFrame:
    """Items of quarantined hosts."""
    return items.join(hosts.select(key).distinct(), key, "left_semi")


def still_served(items: DataFrame, hosts: DataFrame, key: str = "host") -> DataFrame:
    """Items of the other hosts."""
    return items.join(hosts.select(key).distinct(), key, "left_anti")


def quarantine_batches(items: DataFrame, size: int = K.QUARANTINE_BATCH, retries: int = K.QUARANTINE_RETRIES) -> DataFrame:
    """Batch number of each set-aside item, and whether it is retried or dropped.

    Numbering runs over the whole queue in time order, by time slices.
    """
    order = ["ts", "event_id"]
    queue = running_rank(slices(items, order), [], F.col(SLICE), order, "_n").drop(SLICE)
    return queue.withColumn("batch", F.ceil(F.col("_n") / size).cast("bigint")).withColumn(
        "action", F.when(F.coalesce("retries", F.lit(0)) >= retries, "drop").otherwise("retry")
    ).drop("_n")


def probation(items: DataFrame, health: DataFrame, timeout: int = K.TIMEOUT_SECONDS, retries: int = K.RETRY_COUNT) -> DataFrame:
    """Short timeout and no retries for hosts with failures."""
    bad = F.coalesce(F.col("failures") > 0, F.lit(False))
    return (
        items.join(health.select("host", "failures"), "host", "left")
        .withColumn("timeout_s", F.when(bad, K.PROBATION_TIMEOUT_SECONDS).otherwise(timeout))
        .withColumn("max_retries", F.when(bad, K.PROBATION_RETRIES).otherwise(retries))
        .drop("failures")
    )


def file_limit(fetches: DataFrame, limit: int) -> DataFrame:
    """Fetches up to and including the one that reaches the limit of saved files.

    Only the ``limit`` earliest successes are sorted out, by a distributed
    top-k; the rest of the table is filtered against their last position.
    """
    order = F.struct("ts", "event_id")
    first = fetches.filter(F.col("success")).select(order.alias("o")).orderBy("o").limit(limit)
    edge = first.agg(F.when(F.count("*") >= limit, F.max("o")).alias("edge"))
    cut = edge.select("edge").scalar()
    return fetches.filter(cut.isNull() | (order <= cut))


def interstitial_feedback(fetches: DataFrame) -> DataFrame:
    """Web pages received where media was expected, back to the frontier once."""
    page = F.lower("error").contains("webpage/script content")
    once = ~F.coalesce(F.col("interstitial_retry"), F.lit(False))
    return fetches.filter(page & once).select(
        "url",
        F.lit(1).alias("depth"),
        F.lit(15.0).alias("priority_hint"),
        F.lit(True).alias("interstitial_retry"),
        F.col("media_type").alias("original_media_type"),
    )


def counters(fetches: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Images, videos, downloaded and skipped in one aggregate, and the pages read if these are given."""
    found = fetches.agg(
        F.count_if(F.col("media_type") == "image").alias("images_found"),
        F.count_if(F.col("media_type") == "video").alias("videos_found"),
        F.count_if(F.col("success")).alias("files_downloaded"),
        F.count_if(~F.col("success")).alias("files_skipped"),
    )
    if pages is None:
        return found
    return found.withColumn("pages_processed", pages.filter("html IS NOT NULL").agg(F.count("*").alias("n")).scalar())


def progress(counts: DataFrame) -> DataFrame:
    """Whole percent of found files that were processed, 0 when none were found."""
    found = F.col("images_found") + F.col("videos_found")
    done = F.col("files_downloaded") + F.col("files_skipped")
    return counts.withColumn("percent", F.coalesce(F.floor(100 * done / F.nullif(found, F.lit(0))), F.lit(0)).cast("bigint"))
