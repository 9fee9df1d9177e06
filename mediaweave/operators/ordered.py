"""Ordered running values that survive hot keys.

A plain window sorts each key in one task.  When one key may hold a third of all
rows that task never ends, so these helpers cut each key into buckets that
follow the order, work inside a bucket, and carry a small per-bucket summary
across.  The bucket expression must be monotone in the order columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaweave.session import cut_lineage, settled

_BUCKET = "_bucket"
SLICE = "_slice"


ROWS_PER_BUCKET = 1_000_000


def slices(df: DataFrame, order: list[str], rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``_slice``: pieces of about ``rows`` rows that follow the order columns.

    The edges are quantiles that the range partitioner observes, so bursts are cut as
    finely as quiet times, and a key that owns most of the rows is spread whatever the
    volume.  The pieces are written out, as they must not change between uses.
    """
    df = settled(df)
    n = max(1, math.ceil(df.count() / rows))
    if n == 1:
        return df.withColumn(SLICE, F.lit(0))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(SLICE, F.spark_partition_id()))


def _summary_window(keys: list[str]):
    base = W.partitionBy(*keys) if keys else W.partitionBy()
    return base.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)


def running_rank(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``row_number`` over (keys; order): local number plus the rows of earlier buckets."""
    cut = settled(df).withColumn(_BUCKET, bucket)
    by = [*keys, _BUCKET]
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    counts = cut.groupBy(*by).agg(F.count("*").alias("_n"))
    before = counts.select(*by, F.coalesce(F.sum("_n").over(_summary_window(keys)), F.lit(0)).alias("_before"))
    return (
        local.join(before, by)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop(_BUCKET, "_local", "_before")
    )


def floored_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list, step: Column, name: str, count: str | None = None
) -> DataFrame:
    """Running sum of ``step`` that never falls below zero, and optionally the row number.

    With S the running sum and M its running minimum, the value is
    ``S - least(0, M)``; (sum, minimum) pairs of consecutive buckets combine, so
    each bucket only needs the pair of everything before it.
    """
    by = [*keys, _BUCKET]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cut = settled(df).withColumn(_BUCKET, bucket).withColumn("_step", step.cast("bigint"))
    inside = cut.withColumn("_s", F.sum("_step").over(w)).withColumn("_m", F.min("_s").over(w))
    inside = inside.withColumn("_i", F.count("*").over(w))
    totals = inside.groupBy(*by).agg(
        F.sum("_step").alias("_ts"), F.min("_m").alias("_tm"), F.count("*").alias("_tn")
    )
    earlier = _summary_window(keys)
    carried = totals.withColumns(
        {
            "_s0": F.coalesce(F.sum("_ts").over(earlier), F.lit(0)),
            "_n0": F.coalesce(F.sum("_tn").over(earlier), F.lit(0)),
        }
    )
    carried = carried.withColumn("_m0", F.min(F.col("_s0") + F.col("_tm")).over(earlier))
    out = inside.join(carried.select(*by, "_s0", "_n0", "_m0"), by)
    low = F.least(F.lit(0), F.col("_m0"), F.col("_s0") + F.col("_m"))
    out = out.withColumn(name, F.col("_s0") + F.col("_s") - low)
    if count:
        out = out.withColumn(count, F.col("_n0") + F.col("_i"))
    return out.drop(_BUCKET, "_step", "_s", "_m", "_i", "_s0", "_n0", "_m0")


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Position of each row in a total order over the whole table.

    A range-partitioned sort is written out once; a row's position is its place
    in its partition plus the sizes of the partitions before it, which are
    joined as a table of one row per partition.
    """
    placed = cut_lineage(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row per partition of the sort: the one window without keys, whatever the table's size
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    rank = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_before")
    return placed.join(starts, "_part").withColumn(name, rank).drop("_at", "_part", "_before")


def hash_bucket(c) -> Column:
    """First digits of a key's hash (4,096 values): follows the order of ``md5`` itself."""
    return F.substring(F.md5(F.col(c).cast("binary")), 1, 3)
