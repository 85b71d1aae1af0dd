"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from citegrain.catalog import registry
from tests.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_is_offered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "doc_name", "chunk_id", "score", "text"]
    assert df.count() > 0
