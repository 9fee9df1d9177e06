"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLE:
        assert compare(spark, con, sf_dir, QUERIES[name], ORACLE[name]) == []
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_its_query():
    from mediaweave.plans.oracle import ORACLE as everything

    assert set(everything) <= set(QUERIES)
