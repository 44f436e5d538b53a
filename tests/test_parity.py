"""Every named query against its SQL equivalent on the smallest given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from parity import compare, connect

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, data_dir, name):
    assert compare(queries()[name](spark, data_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_runs_and_repeats(spark, data_dir, name):
    runs = [
        sorted(queries()[name](spark, data_dir).collect(), key=repr) for _ in range(2)
    ]
    assert runs[0] and runs[0] == runs[1]


def test_entry(spark):
    assert entry(spark).count() > 0
