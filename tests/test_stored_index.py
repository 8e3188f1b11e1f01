"""The stored index: blocks against postings, lookups against the direct search, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import padded, tokens
from shelfmark.operators import stored_index as si
from shelfmark.operators.phrases import phrase_key, postings, search_bodies


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["a", "b", "c", "dd", "e", "rare"]
    docs = [(i * 37, " ".join(r.choices(words, [20, 9, 5, 3, 2, 0.2], k=r.randint(0, 40))), "b a")
            for i in range(600)]
    docs.append((10 ** 12, "a " * 5000, None))
    bodies = search_bodies(spark.createDataFrame(docs, "id long, f string, g string"), "id", ["f", "g"])
    folder = str(tmp_path_factory.mktemp("index"))
    return docs, bodies, si.store_index(bodies, folder, 4)


def test_blocks_decode_to_the_postings(spark, stored, monkeypatch):
    _, bodies, index = stored
    want = sorted(map(tuple, postings(bodies).select("field", "token", "row_id", "pos").collect()))
    blocks = index.table(index.blocks)
    assert sorted(map(tuple, si.decode_blocks(blocks).collect())) == want
    assert blocks.agg(F.max(F.col("last_row") - F.col("first_row"))).first()[0] < si.ROW_SPAN
    assert blocks.groupBy("field", "token").count().agg(F.max("count")).first()[0] > 4
    assert si.decode_blocks(blocks.limit(0)).count() == 0


def test_lookups(spark, stored):
    docs, _, index = stored
    r = random.Random(5)
    asked = {" ".join(r.choices("a b c dd e rare zz".split(), k=r.randint(1, 4))) for _ in range(80)}
    asked |= {"a " * 4999 + "a", "a " * 5001, "zz"}
    asked = {" ".join(p.split()) for p in asked}
    frame = spark.createDataFrame([("f", p) for p in asked] + [("g", "b a"), ("g", "a b")],
                                  "field string, raw string")
    frame = frame.select("field", padded(tokens(F.col("raw"))).alias("phrase"))
    named = frame.withColumn("phrase_id", phrase_key(F.col("phrase")))
    got = {(x.field, x.phrase.strip(), x.row_id)
           for x in si.lookup(index, frame).join(named, ["field", "phrase_id"]).collect()}
    want = {("f", p, i) for p in asked for i, d, _ in docs if f" {p} " in f" {' '.join(d.split())} "}
    want |= {("g", "b a", i) for i, _, g in docs if g}
    assert got == want
    assert si.lookup(index, frame.limit(0)).count() == 0


def test_a_lookup_does_not_move_the_index(spark, stored):
    _, _, index = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.createDataFrame([("f", "rare", 0)], "field string, token string, block bigint")
        plan = si.blocks_at(index, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
