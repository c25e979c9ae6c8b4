"""The queries with SQL against it, over whole tables at the smallest scale; all others run."""

import os

import pytest

from tests.test_queries import DATA, duck, same  # noqa: F401

from rohspark.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    assert same(spark, duck, queries.QUERIES[name], queries.SQL.get(name))
