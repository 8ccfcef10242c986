"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = {"model_predictions"}


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return db


def test_all_have_sql():
    assert set(catalog.QUERIES) - set(oracle.SQL) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(oracle.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - ROWS_ONLY))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    result = sql.execute(oracle.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
