"""Queries of the subpackage that SQL can express, against that SQL."""

import pytest

import __spark_entry__ as registry
from compare import connect, difference
from recordlens.llm import queries


@pytest.fixture(scope="module")
def duck(tables):
    return connect(tables)


def test_all_queries_are_registered():
    names = set(registry.queries())
    assert set(queries.named()) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.named()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_sql(spark, duck, tables, name):
    assert difference(spark, duck, tables, name) is None
