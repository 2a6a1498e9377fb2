"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) > 0
    if name in ORACLES:
        assert compare(got, con.sql(ORACLES[name]).df()) == []
    else:
        assert len(got) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
