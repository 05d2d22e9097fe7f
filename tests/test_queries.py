"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of, sql_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(spark, con, name):
    assert rows_of(entry.queries()[name](spark, SF)) == sql_rows(con, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"} - {n for n in entry.queries() if n.startswith("op")}))
def test_query_runs(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
    assert all(any(r[c] is not None for r in rows) for c in rows[0].asDict())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
