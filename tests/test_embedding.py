"""Documents, windows, vectors and restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators.embedding import (encode_windows, masked_mean, product_documents,
                                           product_vectors, token_windows, top_reviews, windows)
from shelfmark.plans.vectors import build_vectors, compact


@pytest.mark.parametrize("length, sizes", [(1, [1]), (62, [62]), (63, [62, 11]), (114, [62, 62]),
                                           (115, [62, 62, 11]), (150, [62, 62, 46])])
def test_window_sizes(spark, length, sizes):
    toks = F.sequence(F.lit(1), F.lit(length))
    cut = spark.range(1).select(windows(toks).alias("w")).first().w
    assert [len(w) for w in cut] == sizes
    assert all(a[-10:] == b[:10] for a, b in zip(cut, cut[1:]))


@pytest.fixture
def shop(spark):
    products = spark.createDataFrame(
        [(0, "A", "Toys", " Title ", '["f"]', None), (1, "", "Toys", "x", None, None),
         (2, "B", "Home", "A longer title of a product", "[]", '{"k":"v"}')],
        "product_id long, parent_asin string, main_category string, product_title string, "
        "features_json string, details_json string")
    reviews = spark.createDataFrame(
        [("A", 1, "t1", "first text here"), ("A", None, "t0", "no votes"), ("A", 9, "t9", None),
         ("A", 5, " ", "five"), ("", 3, "lost", "lost")],
        "parent_asin string, helpful_vote long, review_title string, review_text string")
    return products, reviews


def ties():
    return [F.col("review_title"), F.col("review_text")]


def test_documents(spark, shop):
    docs = {r.product_id: r.document for r in product_documents(
        *shop, k=3, min_chars=20, ties=ties()).collect()}
    assert docs == {0: 'Title\n["f"]\nt9\nfive\nt1\nfirst text here',
                    2: 'A longer title of a product\n[]\n{"k":"v"}'}
    assert {r.product_id for r in product_documents(*shop, min_chars=1, ties=ties()).collect()} \
        == {0, 1, 2}


def test_top_reviews_limit_before_shuffle(spark, shop):
    top = top_reviews(shop[1], k=2, ties=ties())
    assert [(r["rank"], r.helpful_vote) for r in top.orderBy("rank").collect()] == [(1, 9), (2, 5)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_reviews_beyond_the_engine_limit(spark):
    rows = spark.range(5000).select(F.lit("A").alias("parent_asin"), F.col("id").alias("helpful_vote"))
    top = top_reviews(rows, k=1500, ties=[])
    assert sorted(r.helpful_vote for r in top.collect()) == list(range(3500, 5000))


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "a", "red red blue " * 60), (2, "b", "!!!"), (3, "c", "red")],
                                 "product_id long, parent_asin string, document string")
    found = {r.product_id: np.array(r.vector) for r in product_vectors(docs).collect()}
    assert np.linalg.norm(found[1]) == pytest.approx(1, abs=1e-6)
    assert not found[2].any() and np.count_nonzero(found[3]) == 1
    again = {r.product_id: np.array(r.vector)
             for r in product_vectors(docs.repartition(3), batch_size=2).collect()}
    assert all(np.array_equal(found[i], again[i]) for i in found)


def test_plugged_in_encoder(spark):
    docs = spark.createDataFrame([(1, "x y z")], "id long, document string")
    rows = token_windows(docs, ["id"]).withColumn("codes", F.transform("tokens", lambda t: F.length(
        t).cast("int")))
    got = encode_windows(rows, ["id"], lambda: lambda batch: np.array(
        [[len(c), c.sum()] for c in batch], dtype=float)).collect()
    assert [(r.window, r.vector) for r in got] == [(0, [3.0, 3.0])]


def test_masked_mean(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0),
                                  (2, [5.0, 5.0], 0)], "id int, v array<double>, m int")
    got = {r.id: r.v for r in masked_mean(rows, ["id"], "v", "m").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_restart_and_compact(spark, shop, tmp_path):
    products, reviews = shop
    shards, out = str(tmp_path / "shards"), str(tmp_path / "out")
    run = lambda **o: build_vectors(products, reviews, shards, page_size=1, ties=ties(), **o)
    assert run(categories=["Toys"]).count() == 1
    assert run().count() == 2
    assert run().count() == 2
    assert compact(spark, shards, out).count() == 2
