"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from queries import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_every_query_has_sql():
    assert set(catalog()) <= set(QUERIES)
    assert set(catalog()) <= set(SQL)


def test_entry(spark):
    assert entry(spark).count() == 200
