"""Every named query equals its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark import catalog
from tools.compare import TABLES, kinds_of, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = db.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert kinds_of(got) == kinds_of(want)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
