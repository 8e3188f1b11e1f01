"""The list of all filters: every kind of filter is in it, in the order of its product's list."""

import duckdb

import __spark_entry__ as entry
from shelfmark.constants import FILTER_KINDS

SQL_TYPES = ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double")


def test_every_kind_is_listed(spark, tmp_path):
    parts = [(1, "Red Ring and Blue Bolt", "Brand#1", "SMALL", 30, 10.0),
             (2, "red ring", "Brand#2", "PROMO", 3, 20.0),
             (3, "Blue Bolt", "Brand#1", "SMALL", 30, 30.0)]
    lines = [(10, 1, 1, "F", "R"), (11, 2, 1, "F", "R"), (12, 3, 1, "F", "A")]
    spark.createDataFrame(parts, SQL_TYPES).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, "
                                 "l_linestatus string, l_returnflag string") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.product_id: r for r in entry.queries()["q_filters_all"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2]   # product 3 is not in the reduced set
    listed = [f.split(":") for f in got[1].listed.split(" ")]
    assert len(listed) == got[1].n
    assert list(dict.fromkeys(c for c, _ in listed)) == list(FILTER_KINDS)
    # Phrases in text order: "Red Ring" is in two titles, "Blue Bolt" in two.
    assert [int(n) for c, n in listed if c == "product_title"] == [2, 2]
    # Features: both entities of the name, "Made", "Brand" and the whole of "size 30"; details: the
    # brand, the type, the size and the flag.
    assert [int(n) for c, n in listed if c == "features_json"] == [2, 2, 3, 3, 2]
    assert [int(n) for c, n in listed if c == "details_json"] == [3, 2, 2, 3]

    db = duckdb.connect()
    for name in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["q_filters_all"]).fetchall()
    assert sorted(want) == sorted((r.product_id, r.n, r.listed) for r in got.values())
