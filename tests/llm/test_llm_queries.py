"""The queries about training data on the smallest tables, against their SQL where there is one."""

import os

import pytest

from corvane.llm import queries

compare = pytest.importorskip("compare")
pytestmark = pytest.mark.skipif(not os.path.isdir(compare.DATA), reason="no tables here")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, compare.DATA)
    if name in queries.SQL:
        assert compare.canonical(got.toPandas()) == compare.canonical(compare.database().execute(queries.SQL[name]).df())
    else:
        assert got.count() > 0
