"""Every registered query: results equal DuckDB's where SQL is given."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
# The text operators are tested in tests/llm.
TEXT = {n for n in QUERIES if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(CHECKS) - TEXT))
def test_equals_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], CHECKS[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - TEXT))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 5
