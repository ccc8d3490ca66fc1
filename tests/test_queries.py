"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from silvaspark.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        c.sql(f"create view {f.split('.')[0]} as select * from '{path}'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = db.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert ordered(tuple(r[c] for c in columns) for r in found.collect()) == ordered(tuple(r[i] for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", ["rf_classify", "rf_importance", "reproject"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
