"""Joins of tables that both grow: none is sent through the driver, however small its files are."""

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import filters as flt, ranges
from shelfmark.operators.selection import products_of_interest, queries_with_product
from shelfmark.operators.update import set_filters
from shelfmark.sources.versions import create_table, update_table

#: One row per column, or per column and bucket, may be broadcast.
BOUNDED = {ranges.COLUMN, f"{ranges.COLUMN}, bucket"}

KINDS = {"main_category": "exact_match", "price": "range"}


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    """Few values in many rows: files far below the engine's limit for broadcasts."""
    path = str(tmp_path_factory.mktemp("products") / "t")
    spark.range(3000).select(
        F.col("id").alias("product_id"), F.concat(F.lit("P"), F.col("id")).alias("parent_asin"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("main_category"),
        (F.col("id") % 40).cast("double").alias("price"), F.lit("[]").alias("filters_json")
    ).write.parquet(path)
    return spark.read.parquet(path)


def broadcast_keys(df):
    """Left keys of every broadcast join, without expression ids."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan
    return {re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}


def test_selection(products):
    asked = products.select(F.col("parent_asin").alias("product_id"))
    assert not broadcast_keys(products_of_interest(products, asked))
    assert not broadcast_keys(queries_with_product(asked, products))


def test_filters(products):
    assert not broadcast_keys(flt.exact_filters(products, products, 3000, KINDS))
    found = flt.range_filters(products, products, 3000, KINDS)
    assert broadcast_keys(found) <= BOUNDED
    assert found.count() > 0
    assert broadcast_keys(flt.filter_lists(products, found)) <= BOUNDED


def test_ranges(products):
    dist = ranges.distribution(products, ["price"]).cache()
    aimed = ranges.target_ranges(dist, dist.select(ranges.COLUMN, "value")).cache()
    placed = [ranges.target_ranges(dist, dist.select(ranges.COLUMN, "value")),
              ranges.range_counts(dist, aimed)]
    assert all(broadcast_keys(df) <= BOUNDED for df in placed)


def test_updates(spark, products, tmp_path):
    updates = products.select("product_id", F.lit("[1]").alias("new_filters"))
    assert not broadcast_keys(set_filters(products, updates))
    root, seen = str(tmp_path / "t"), []

    def change(rows):
        seen.append(set_filters(rows, updates))
        return seen[-1]

    create_table(products, root, "product_id", 2)
    assert update_table(spark, root, updates, "product_id", change).filter("filters_json = '[1]'").count() == 3000
    assert not broadcast_keys(seen[0])


def test_whole_flows(products):
    """Bands, lists, unique and range filters, each as a query runs it."""
    interest = products_of_interest(products, products.select(F.col("parent_asin").alias("product_id")))
    every = flt.all_filters(products, interest, KINDS)
    unique = flt.unique_filters(every)
    flows = [flt.product_bands(unique), flt.filter_lists(interest, every), unique,
             flt.range_filters(products, interest, 3000, KINDS)]
    assert all(broadcast_keys(df) <= BOUNDED for df in flows)
