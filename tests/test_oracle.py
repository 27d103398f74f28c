"""Every query with an SQL oracle gives the oracle's rows."""

from __future__ import annotations

import pytest
from oracle import SMALL, compare, connect

from __spark_entry__ import oracle_sql, queries

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    assert compare(QUERIES[key](spark, SMALL), con, ORACLES[key]) is None


def test_keys_agree():
    assert set(ORACLES) <= set(QUERIES)
