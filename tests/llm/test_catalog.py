"""Queries with SQL equal it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark.llm import catalog
from tools.compare import TABLES, kinds_of, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF).toArrow()
    want = db.execute(catalog.SQL[name]).to_arrow_table()
    assert kinds_of(got) == kinds_of(want) and rows_of(got) == rows_of(want)
