"""Every registered query that has SQL returns the same rows as DuckDB."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    found, expected = oracle.compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "id" and rows.count() > 0
