"""Run registered queries on both engines and compare them.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def compare(spark, con, sf_dir, fn, sql) -> list[str]:
    """Differences between the engines; empty when they agree."""
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    theirs = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    a, b = table(df.columns, mine), table(rel.columns, theirs)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        problems.append(f"values: spark only {left} / sql only {right}")
    if not a:
        problems.append("no rows")
    return problems


def main(argv):
    import __spark_entry__ as entry
    from mediaweave.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark, con = local_session(8), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in oracle:
                problems = compare(spark, con, sf_dir, fn, oracle[name])
                n = ""
            else:
                n = f"rows {fn(spark, sf_dir).count()}"
                problems = []
        except Exception as e:
            problems, n = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.1f}s {n} {'' if name in oracle else '(no sql)'}", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    missing = set(oracle) - set(queries)
    print("bad", bad, "of", len(queries), "sql without query", sorted(missing))
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
