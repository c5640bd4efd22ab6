"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registry
from compare import connect, difference
from workload import catalog


@pytest.fixture(scope="module")
def duck(tables):
    return connect(tables)


def test_every_query_has_sql():
    assert set(catalog.named()) <= set(registry.oracle_sql())
    assert len(catalog.named()) >= 50


@pytest.mark.parametrize("name", sorted(catalog.named()))
def test_query_equals_sql(spark, duck, tables, name):
    assert difference(spark, duck, tables, name) is None


def test_entry_returns_rows(spark):
    assert registry.entry(spark).count() == 10
