"""Snapshots, streams that end when idle, and waves of a hot host."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mediaweave.operators import manifest as Mf
from mediaweave.sources import files as Fs
from mediaweave.streaming import streams as St


def test_last_whole_snapshot_counts(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        Fs.load_snapshot(spark, folder)
    tables = {n: spark.createDataFrame([(n, k) for k in range(3)], "name string, k int") for n in Fs.STATE_TABLES}
    for version in (1, 2, 10):
        Fs.save_snapshot({n: t.withColumn("v", F.lit(version)) for n, t in tables.items()}, folder, version)
    Fs.write_tables(tables, f"{folder}/version=11")  # all tables, but no marker
    assert Fs.snapshots(spark, folder) == [1, 2, 10]
    version, back = Fs.load_snapshot(spark, folder)
    assert version == 10 and set(back) == set(Fs.STATE_TABLES)
    for name, table in back.items():
        assert sorted(map(tuple, table.collect())) == [(name, k, 10) for k in range(3)]
    with pytest.raises(ValueError):
        Fs.save_snapshot({"frontier": tables["frontier"]}, folder, 12)
    assert Fs.snapshots(spark, folder) == [1, 2, 10]


def test_stream_ends_when_idle_and_not_before(spark, tmp_path):
    rows = spark.range(10).withColumn("part", F.col("id") % 5)
    rows.filter("part = 0").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    came = []

    def more(batches):
        came.append(batches)
        if batches < 4:  # each arrives after most of the idle time
            time.sleep(1.5)
            rows.filter(f"part = {batches}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    began = time.monotonic()
    batches = St.run_until_idle(stream, f"{tmp_path}/check", f"{tmp_path}/out", idle=2.0, after_batch=more)
    assert time.monotonic() - began > 3 * 1.5 + 2
    assert [b["rows"] for b in batches] == [2, 2, 2, 2] and came == [1, 2, 3, 4]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [k for k in range(10) if k % 5 < 4]


def test_waves_of_a_hot_host(spark):
    """Nine of ten files on one host, all of different priorities, numbered in small slices."""
    rng = random.Random(1)
    rows = [(f"http://h/{i}", "hot" if i % 10 else f"h{i}", rng.random() * 100 if i % 7 else None) for i in range(3000)]
    out = Mf.waves(spark.createDataFrame(rows, "url string, host string, priority double"), 2, slice_rows=200).collect()
    by_host = {}
    for r in out:
        by_host.setdefault(r.host, []).append(r)
    assert len(out) == 3000
    for found in by_host.values():
        found.sort(key=lambda r: r.wave)
        assert [r.wave for r in found] == [k // 2 + 1 for k in range(len(found))]
        edge = [r.priority if r.priority is not None else float("-inf") for r in found]
        assert all(min(edge[k : k + 2]) >= max(edge[k + 2 : k + 4], default=float("-inf")) for k in range(0, len(edge), 2))
