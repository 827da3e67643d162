"""Every query that has an oracle gives the oracle's rows."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_oracle(spark, sf_dir, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
