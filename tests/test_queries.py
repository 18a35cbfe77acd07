"""Every registered query outside the llm subpackage on the smallest tables, against its SQL where there is one."""

import os

import pytest

from corvane.plans import registry

compare = pytest.importorskip("compare")
pytestmark = pytest.mark.skipif(not os.path.isdir(compare.DATA), reason="no tables here")


@pytest.fixture(scope="module")
def database():
    pytest.importorskip("duckdb")
    return compare.database()


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, database, name):
    got = registry.queries()[name](spark, compare.DATA)
    if name in registry.sql():
        assert compare.canonical(got.toPandas()) == compare.canonical(database.execute(registry.sql()[name]).df())
    else:
        assert got.count() > 0


def test_sql_belongs_to_queries():
    assert set(registry.sql()) <= set(registry.queries())
