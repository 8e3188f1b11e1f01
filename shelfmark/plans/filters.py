"""Filters with selectivity for the products of interest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shelfmark.constants import FILTER_KINDS
from shelfmark.functions.text import entity_lists
from shelfmark.operators.filters import (all_filters, band_totals, filter_lists, product_bands,
                                         unique_filters)
from shelfmark.operators.selection import products_of_interest
from shelfmark.session import stage
from shelfmark.sources.filters import filters_json, write_filter_lines


@dataclass
class FilterSets:
    every: DataFrame          # one row per filter
    unique: DataFrame         # after dropping equal (column, count, percentage)
    products: DataFrame       # products of interest with their unique filter array
    bands: DataFrame          # per product
    band_totals: DataFrame    # one row


def generate(products: DataFrame, queries: DataFrame, kinds: dict[str, str] = FILTER_KINDS,
             entities=entity_lists) -> FilterSets:
    """All filters of the judged products, counted over the whole product table."""
    interest = stage(products_of_interest(products, queries), "interest")
    every = stage(all_filters(products, interest, kinds, entities), "filters")
    unique = stage(unique_filters(every), "unique-filters")
    return FilterSets(every, unique, filter_lists(interest, unique), product_bands(unique),
                      band_totals(unique))


def build_filters(products: DataFrame, queries: DataFrame, out: str, **options) -> FilterSets:
    """Write both filter documents, all filters and the unique ones, as JSON lines."""
    sets = generate(products, queries, **options)
    interest = sets.products.drop("filters")
    write_filter_lines(filter_lists(interest, sets.every), f"{out}/filters_all")
    write_filter_lines(sets.products, f"{out}/filters_deduplicated")
    return sets


def filter_entries(products_with_filters: DataFrame) -> DataFrame:
    """Generated filters in the shape of the update source, without a detour over files."""
    return products_with_filters.select(
        F.col("product_id").cast("string").alias("product_id"),
        filters_json(F.col("filters")).alias("filters"),
        F.struct(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("position"))
