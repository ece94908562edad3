"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.catalog import catalog
from checks.compare import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert all(item.oracle for item in catalog().values())
    assert catalog().keys() <= contract.queries().keys()
    assert catalog().keys() <= contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry_returns_rows(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["store_id", "date"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, [name])[name].startswith("ok")
