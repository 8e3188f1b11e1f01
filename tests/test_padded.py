"""Padded texts: built in one pass and once, the same as through token arrays."""

from pyspark.sql import functions as F

from shelfmark.functions.text import (NO_TOKENS, TOKEN_CHARACTER, padded, padded_text, tokens)
from shelfmark.operators.phrases import describe_phrases, postings, search_bodies, token_stats
from shelfmark.operators.stored_index import block_stats, encode_blocks


def test_padded_text_is_padded_tokens(spark):
    points = [chr(c) for c in range(1, 0x3100)] + [chr(c) for c in (0xA7CB, 0xA7DC, 0xE000, 0x1D538)]
    texts = ["", " ", "--", None, "A  b", "-x-", "é́a ́ b", "Größe 5GB, ǅ"] + [f"- {c} ;" for c in points]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = padded(tokens(F.col("t")))
    assert rows.filter(~slow.eqNullSafe(padded_text(F.col("t")))).count() == 0
    assert rows.filter((slow != NO_TOKENS) != F.lower("t").rlike(TOKEN_CHARACTER)).count() == 0


def test_bodies_are_built_once(spark, tmp_path):
    spark.createDataFrame([(1, "A b"), (2, "--"), (3, None), (4, "")], "id int, t string").write.parquet(
        str(tmp_path / "t"))
    bodies = search_bodies(spark.read.parquet(str(tmp_path / "t")), "id", ["t"])
    plan = bodies._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    assert [tuple(r) for r in bodies.collect()] == [(1, "t", " a b ")]


def test_statistics_of_blocks(spark):
    bodies = spark.createDataFrame(
        [("f", 3, " a b a "), ("f", 3, " b "), ("f", 9, " b "), ("f", 5000, " a "), ("g", 5000, " a ")],
        "field string, row_id int, body string")
    stats = block_stats(encode_blocks(bodies))
    plain = token_stats(postings(bodies))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, plain.collect()))
    assert "row_id" not in stats._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_phrases_are_described_once(spark):
    listed = spark.createDataFrame([("f", " a b ")] * 50 + [("g", " a b ")], "field string, phrase string")
    found = describe_phrases(listed)
    assert found.count() == 2 and {r.field for r in found.collect()} == {"f", "g"}
