"""Keyed update of the product table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.clean import to_int
from shelfmark.session import by_merge


def filter_updates(entries: DataFrame) -> DataFrame:
    """One row per product id: the last entry in document order wins.

    Entries without filters or without a whole-number id are left out. The last entry is found by
    a partial aggregate, so an id that repeats very often does not gather in one task.
    """
    usable = entries.withColumn("product_id", to_int(F.col("product_id").cast("string"))).filter(
        F.col("product_id").isNotNull() & F.col("filters").isNotNull())
    return usable.groupBy("product_id").agg(F.max_by("filters", "position").alias("new_filters"))


def rejected_updates(entries: DataFrame) -> DataFrame:
    """Entries that cannot be applied."""
    ok = to_int(F.col("product_id").cast("string")).isNotNull() & F.col("filters").isNotNull()
    return entries.filter(~ok)


def apply_filters(products: DataFrame, entries: DataFrame) -> DataFrame:
    """Set ``filters_json`` by ``product_id``; unknown ids change nothing, other rows stay.

    Write the result to a new path and swap; applying the same entries again changes nothing.
    """
    return set_filters(products, filter_updates(entries))


def set_filters(products: DataFrame, updates: DataFrame) -> DataFrame:
    """The same with one row ``(product_id, new_filters)`` per id."""
    joined = products.join(by_merge(updates), "product_id", "left")
    return joined.withColumn("filters_json", F.coalesce("new_filters", "filters_json")).select(
        *products.columns)


def updated_count(products: DataFrame, entries: DataFrame) -> int:
    """Number of products that an update touches."""
    return products.join(by_merge(filter_updates(entries)), "product_id", "left_semi").count()
