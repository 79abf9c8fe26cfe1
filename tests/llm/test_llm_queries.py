"""The registered queries: names, and those that SQL can express against it."""

from __future__ import annotations

import re

import pytest
from compare import connect, difference

from __spark_entry__ import oracle_sql, queries
from rowgate.llm import catalog

SF_DIR = "/root/testdata/sf0.01"


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog())
    assert numbers == list(range(1, 14))
    assert {*catalog(), "pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in catalog().items() if sql))
def test_query_equals_sql(spark, name):
    assert difference(queries()[name](spark, SF_DIR), connect(SF_DIR), oracle_sql()[name]) is None
