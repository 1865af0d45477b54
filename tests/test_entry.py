"""Every registered query against its SQL form, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def sortable(row):
    return [(value is None, str(type(value)), str(value)) for value in row]


def test_every_sql_form_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry._oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    found = entry.queries()[name](spark, SF_DIR)
    result = sql.execute(entry._oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    expected = sorted(map(tuple, result.fetchall()), key=sortable)
    assert expected, "the comparison would be vacuous"
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=sortable) == expected


def test_queries_without_sql(spark):
    rows = {name: entry.queries()[name](spark, SF_DIR) for name in set(entry._queries()) - set(entry._oracle_sql())}
    assert set(rows) == {"near_duplicates_approximate"}
    pairs = {(r.row_a, r.row_b) for r in rows["near_duplicates_approximate"].collect()}
    exact = {(r.row_a, r.row_b) for r in entry.queries()["near_duplicates_documents"](spark, SF_DIR).collect()}
    assert pairs <= exact and len(pairs) >= 0.9 * len(exact) > 0


def test_flagship_query(spark):
    found = entry.entry(spark)
    assert found.columns == ["row_a", "row_b", "similarity"] and found.count() == 50
