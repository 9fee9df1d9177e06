"""Task tables: settings, queue order, status, import, export and posted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave import constants as K
from mediaweave.functions import urls as U
from mediaweave.operators.ordered import global_rank


def clamp_settings(tasks: DataFrame) -> DataFrame:
    """Numeric settings into their ranges, bad ones to their default; headers lose line breaks."""
    settings = F.col("settings")

    def entry(e):
        arms = None
        for name, (low, high, default) in K.SETTING_RANGES.items():
            number = U.as_int(e["value"])
            fixed = F.when(number.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))
            value = fixed.cast("string")
            arms = F.when(e["key"] == name, value) if arms is None else arms.when(e["key"] == name, value)
        arms = arms.when(e["key"].isin(K.HEADER_SETTINGS), F.translate(e["value"], "\r\n", ""))
        value = F.when(e["value"].isNotNull(), arms.otherwise(e["value"]))
        return F.struct(e["key"].alias("key"), value.alias("value"))

    return tasks.withColumn("settings", F.map_from_entries(F.transform(F.map_entries(settings), entry)))


def queue_order(tasks: DataFrame) -> DataFrame:
    """Live tasks before finished ones, each in order of arrival, with their position."""
    finished = F.col("status").isin(K.TERMINAL_STATUSES)
    return global_rank(tasks.withColumn("finished", finished), ["finished", "created_at", "id"], "position")


def next_task(tasks: DataFrame) -> DataFrame:
    """First queued or paused task."""
    waiting = tasks.filter(F.col("status").isin("queued", "paused"))
    return waiting.orderBy("created_at", "id").limit(1)


def task_status(events: DataFrame) -> DataFrame:
    """Status and times per task after all its events.

    Starting a task pauses the one that is running.  A task whose last event is
    a start still runs only if no other task was started later; one scalar (the
    last start of all) decides that.
    """
    order = F.struct("ts", "event_id")
    is_start = F.col("action") == "start"
    last_start_of_all = events.filter(is_start).agg(F.max(order).alias("o")).scalar()
    ends = F.col("action").isin("complete", "stop", "fail")
    per_task = events.groupBy("task_id").agg(
        F.max_by("action", order).alias("last_action"),
        F.max(F.when(is_start, order)).alias("last_start"),
        F.max(F.when(ends, order)).alias("last_end"),
    )
    status = (
        F.when(F.col("last_action") == "pause", "paused")
        .when(F.col("last_action") == "complete", "completed")
        .when(F.col("last_action") == "stop", "stopped")
        .when(F.col("last_action") == "fail", "failed")
        .when(F.col("last_start") < last_start_of_all, "paused")
        .otherwise("running")
    )
    ended = F.when(F.col("last_start").isNull() | (F.col("last_end") > F.col("last_start")), F.col("last_end.ts"))
    return per_task.select(
        "task_id", status.alias("status"), F.col("last_start.ts").alias("started_at"), ended.alias("completed_at")
    )


def status_summary(tasks: DataFrame) -> DataFrame:
    """Active tasks, queue length and files downloaded by the active ones."""
    running = F.col("status") == "running"
    return tasks.agg(
        F.count_if(running).alias("active"),
        F.count("*").alias("queue_length"),
        F.coalesce(F.sum(F.when(running, F.col("files_downloaded"))), F.lit(0)).alias("files_downloaded"),
    )


def export_rows(tasks: DataFrame) -> DataFrame:
    """The ten columns of the task export, in queue order."""
    stats = F.col("stats")

    def stat(name):
        return F.coalesce(stats[name], F.lit(0))

    def stamp(name):
        return F.coalesce(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit(""))

    return queue_order(tasks).select(
        F.col("position").alias("#"),
        F.col("id").alias("ID"),
        F.col("url").alias("URL"),
        F.col("status").alias("Status"),
        stat("files_downloaded").alias("Downloaded"),
        (stat("images_found") + stat("videos_found")).alias("Found"),
        stamp("created_at").alias("Created"),
        stamp("started_at").alias("Started"),
        stamp("completed_at").alias("Completed"),
        F.col("download_path").alias("Path"),
    )


def import_rows(rows: DataFrame, outputs: DataFrame, ts: Column) -> DataFrame:
    """Imported tasks: blank URLs skipped, known non-empty folders restored, others queued."""
    url = F.trim(F.coalesce("URL", F.lit("")))
    known = outputs.filter(F.col("n_files") > 0).select(F.col("path").alias("_path")).distinct()
    path = F.trim(F.coalesce("Path", F.lit("")))
    joined = rows.select(url.alias("url"), path.alias("old_path")).join(
        known, F.col("old_path") == F.col("_path"), "left"
    )
    outcome = (
        F.when(F.col("url") == "", "skipped")
        .when((F.col("old_path") != "") & F.col("_path").isNotNull(), "restored")
        .otherwise("queued")
    )
    return joined.select(
        "url",
        outcome.alias("outcome"),
        F.when(outcome == "restored", F.col("old_path"))
        .when(outcome == "queued", U.task_folder("url", ts))
        .alias("download_path"),
        F.when(outcome == "restored", "completed").when(outcome == "queued", "queued").alias("status"),
    )


def outcome_counts(imported: DataFrame) -> DataFrame:
    return imported.groupBy("outcome").agg(F.count("*").alias("n"))


_POSTED = "struct<urls:array<struct<url:string,source:string,type:string,original_url:string,transformed:boolean>>,one_shot:boolean>"


def posted_items(posts: DataFrame) -> DataFrame:
    """Items of posted bodies (``post_id``, ``body``).

    One-shot bodies accept ``http(s)`` and ``//`` URLs, normalise them and name
    the file; other bodies accept ``http(s)`` only and become tasks as they are.
    A nameless item is called after the number of items accepted before it.
    """
    body = F.from_json("body", _POSTED)
    one_shot = F.coalesce(F.col("b.one_shot"), F.lit(False))
    trimmed = F.transform(F.col("b.urls"), lambda u: F.struct(F.trim(F.coalesce(u["url"], F.lit(""))).alias("raw"), u.alias("u")))
    wanted = F.filter(trimmed, lambda x: x["raw"].rlike("^https?://") | (one_shot & x["raw"].startswith("//")))
    rows = posts.withColumn("b", body).select(
        "post_id",
        one_shot.alias("one_shot"),
        F.get("b.urls", 0)["source"].alias("source_page"),
        F.posexplode(wanted).alias("pos", "x"),
    )
    whole = F.when(F.col("x.raw").startswith("//"), F.concat(F.lit("https:"), F.col("x.raw"))).otherwise(F.col("x.raw"))
    url = F.when(F.col("one_shot"), U.normalize_url(whole)).otherwise(whole)
    named = rows.withColumn("url", F.explode(F.array(url)))
    base = U.file_basename("url")
    name = F.when(base.contains("."), base).otherwise(F.concat(F.lit("media_"), F.col("pos").cast("string"), F.lit(".jpg")))
    return named.select(
        "post_id",
        "pos",
        "one_shot",
        "url",
        F.when(F.col("one_shot"), F.coalesce("source_page", F.lit(""))).alias("source_url"),
        F.when(F.col("one_shot"), F.coalesce("x.u.type", F.lit("image"))).alias("media_type"),
        F.when(F.col("one_shot"), name).alias("filename"),
    )


def without_one_shot_links(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Links of tasks that crawl on; page-only tasks keep their media but no links."""
    single = tasks.filter(F.col("one_shot")).select("task_id")
    return links.join(single, "task_id", "left_anti")
