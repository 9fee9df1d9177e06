"""Ordered operators against plain folds, with one key holding most rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from mediaweave.operators import health as H
from mediaweave.operators import manifest as Mf
from mediaweave.operators.ordered import floored_sum, global_rank, hash_bucket, running_rank


def events(n=600, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 3 + ["a", "b", "c"]), rng.randrange(50), rng.choice([-1, 0, 1, 1])) for i in range(n)]


def test_floored_sum_is_the_ordered_fold(spark):
    rows = events()
    df = spark.createDataFrame(rows, "id long, k string, t long, step long").repartition(5)
    out = floored_sum(df, ["k"], F.floor(F.col("t") / 7), ["t", "id"], F.col("step"), "f", "n").collect()
    got = {r["id"]: (r["f"], r["n"]) for r in out}
    state = defaultdict(int)
    count = defaultdict(int)
    for i, k, t, step in sorted(rows, key=lambda r: (r[2], r[0])):
        state[k] = max(0, state[k] + step)
        count[k] += 1
        assert got[i] == (state[k], count[k])


def test_running_rank_is_row_number(spark):
    rows = events()
    df = spark.createDataFrame(rows, "id long, k string, t long, step long").repartition(5)
    got = {r["id"]: r["rank"] for r in running_rank(df, ["k"], F.floor(F.col("t") / 7), ["t", "id"]).collect()}
    seen = defaultdict(int)
    for i, k, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[k] += 1
        assert got[i] == seen[k]


def test_global_rank(spark):
    rows = events()
    df = spark.createDataFrame(rows, "id long, k string, t long, step long").repartition(5)
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("t"), "id"]).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    assert got == want


def test_unique_names_pass_over_names_in_use(spark):
    rng = random.Random(5)
    names = ["a.jpg"] * 12 + ["a_1.jpg", "a_2.jpg", "a_2.jpg", "a_5.jpg", "b", "b", "b_1", ".x", ".x", "a_1_1.jpg"]
    rng.shuffle(names)
    rows = [(f"u{i}", "d", name) for i, name in enumerate(names)] + [("v", "e", "a.jpg")]
    df = spark.createDataFrame(rows, "url string, dir string, filename string")
    out = Mf.unique_names(df).collect()
    assert len(out) == len(rows)
    finals = [(r["dir"], r["unique_name"]) for r in out]
    assert len(set(finals)) == len(finals)
    mine = sorted(r["unique_name"] for r in out if r["dir"] == "d" and r["filename"] == "a.jpg")
    assert mine == sorted(["a.jpg"] + [f"a_{n}.jpg" for n in (3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14)])
    for name in set(names):  # every name in use stays with a file that really has it
        assert sum(1 for r in out if r["dir"] == "d" and r["unique_name"] == name and r["filename"] == name) == 1


def test_hash_bucket_follows_the_hash(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    rows = df.select(F.md5(F.col("k").cast("binary")).alias("h"), hash_bucket("k").alias("b")).orderBy("h").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_waves_hold_two_per_host(spark):
    rows = [(f"https://h/{i}", "h", float(i)) for i in range(21)]
    out = Mf.waves(spark.createDataFrame(rows, "url string, host string, priority double")).collect()
    per_wave = defaultdict(int)
    for r in out:
        per_wave[r["wave"]] += 1
    assert max(per_wave.values()) == 2 and max(per_wave) == 11
    assert max(r["wave"] for r in out if r["priority"] >= 10) <= min(r["wave"] for r in out if r["priority"] < 1)


def brute_health(rows, limit=3):
    state = {}
    for _, host, ts, ok, skip in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(host, {"failures": 0, "total": 0, "at": None})
        if s["at"] is not None:
            continue
        s["total"] += 1
        if ok:
            s["failures"] = max(0, s["failures"] - 1)
        elif not skip:
            s["failures"] += 1
            if s["failures"] >= limit:
                s["at"] = ts
    return state


def test_host_health_against_the_fold(spark):
    import datetime as dt

    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(500):
        ok = rng.random() < 0.6
        rows.append((i, rng.choice(["hot"] * 4 + ["a", "b", "c", "d"]), start + dt.timedelta(minutes=rng.randrange(3000)), ok, not ok and rng.random() < 0.3))
    df = spark.createDataFrame(rows, "event_id long, host string, ts timestamp_ntz, success boolean, content_skip boolean")
    got = {r["host"]: r for r in H.host_health(df).collect()}
    for host, want in brute_health(rows).items():
        assert (got[host]["failures"], got[host]["total"], got[host]["quarantined_at"]) == (want["failures"], want["total"], want["at"])


def test_byte_ranges_cover_the_file(spark):
    df = spark.createDataFrame([(1, 50_000_001, True), (2, 50_000_001, False), (3, 1000, True)], "id int, content_length long, accepts_ranges boolean")
    out = Mf.byte_ranges(df, 8).orderBy("id", "part").collect()
    first = [r for r in out if r["id"] == 1]
    assert len(first) == 8 and first[0]["first_byte"] == 0 and first[-1]["last_byte"] == 50_000_000
    assert all(a["last_byte"] + 1 == b["first_byte"] for a, b in zip(first, first[1:]))
    assert [(r["first_byte"], r["last_byte"]) for r in out if r["id"] != 1] == [(0, 50_000_000), (0, 999)]


def test_slices_follow_bursts(spark):
    """Nine tenths of the rows in one minute and one key: no slice holds many more rows than asked for."""
    from mediaweave.operators.ordered import SLICE, slices

    n = 20_000
    df = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 10 == 0, F.col("id") * 100_000).otherwise(1_000_000 + F.col("id") % 60).alias("t"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(0).alias("k"),
        F.when(F.hash("id") % 3 == 0, -1).otherwise(1).alias("step"),
    )
    order = ["t", "event_id"]
    cut = slices(df, order, rows=500)
    sizes = [r["count"] for r in cut.groupBy(SLICE).count().collect()]
    assert sum(sizes) == n and max(sizes) < 1500
    got = {r["event_id"]: r["f"] for r in floored_sum(cut, ["k"], F.col(SLICE), order, F.col("step"), "f").collect()}
    score, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["t"], r["event_id"])):
        score[r["k"]] = want[r["event_id"]] = max(0, score.get(r["k"], 0) + r["step"])
    assert got == want
