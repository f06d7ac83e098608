"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from comparison import connect, difference

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert difference(result, con, SQL[name]) is None
    else:
        assert result.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_a_row(spark):
    assert entry_points.entry(spark).count() == 1
