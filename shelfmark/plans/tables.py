"""Raw JSON lines to typed product and review tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.constants import PRODUCT_COLUMNS, PRODUCT_FILE_PREFIX, REVIEW_COLUMNS
from shelfmark.functions.clean import timestamp_text
from shelfmark.operators.keys import dense_ids
from shelfmark.operators.records import normalize_products, normalize_reviews
from shelfmark.schemas import PRODUCTS, REVIEWS
from shelfmark.sources.jsonl import (PRODUCT_KEYS, REVIEW_KEYS, Keys, is_product_file, parse_lines,
                                     read_lines, rejected_lines, valid_records)
from shelfmark.sources.tables import pick_columns, write_csv, write_table


@dataclass
class Cleaned:
    products: DataFrame
    reviews: DataFrame
    rejects: DataFrame


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Numbered product rows from the product files of a folder."""
    parsed = parse_lines(read_lines(spark, path, f"{PRODUCT_FILE_PREFIX}*.jsonl"), PRODUCT_KEYS)
    numbered = dense_ids(normalize_products(valid_records(parsed)), "product_id")
    return pick_columns(numbered, PRODUCTS)


def read_reviews(spark: SparkSession, path: str, **options) -> DataFrame:
    """Review rows from all other files of a folder."""
    lines = read_lines(spark, path).filter(~is_product_file(F.col("src_file")))
    return pick_columns(normalize_reviews(valid_records(parse_lines(lines, REVIEW_KEYS)), **options), REVIEWS)


def clean_folder(spark: SparkSession, path: str, **review_options) -> Cleaned:
    """Products, reviews and the lines that could not be read."""
    return Cleaned(
        products=read_products(spark, path),
        reviews=read_reviews(spark, path, **review_options),
        rejects=rejected_lines(parse_lines(read_lines(spark, path), Keys(plain=()))),
    )


def build_tables(spark: SparkSession, path: str, out: str, csv: bool = False) -> Cleaned:
    """Write ``products``, ``reviews`` and ``rejects`` below ``out``; optionally CSV as well."""
    cleaned = clean_folder(spark, path)
    products = write_table(cleaned.products, f"{out}/products", PRODUCTS)
    reviews = write_table(cleaned.reviews, f"{out}/reviews", REVIEWS)
    rejects = write_table(cleaned.rejects, f"{out}/rejects")
    if csv:
        write_csv(products, f"{out}/products_csv", PRODUCT_COLUMNS)
        write_csv(reviews.withColumn("review_ts", timestamp_text(F.col("review_ts"))),
                  f"{out}/reviews_csv", REVIEW_COLUMNS)
    return Cleaned(products, reviews, rejects)
