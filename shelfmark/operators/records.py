"""Normalised product and review records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.clean import clean_timestamp, to_bool01, to_float, to_int
from shelfmark.sources.jsonl import POSITION, PRODUCT_KEYS, REVIEW_KEYS, record_of


def normalize_products(records: DataFrame) -> DataFrame:
    """One projection per record; position columns pass through for the numbering."""
    r = record_of(PRODUCT_KEYS)
    return records.select(
        *[c for c in POSITION if c in records.columns],
        r.text("parent_asin").alias("parent_asin"),
        r.text("main_category").alias("main_category"),
        r.text("title").alias("product_title"),
        to_float(r.number_text("average_rating")).alias("average_rating"),
        to_int(r.number_text("rating_number")).alias("rating_number"),
        r.json("features").alias("features_json"),
        r.joined("description").alias("product_description"),
        r.price("price").alias("price"),
        r.json("images").alias("images_json"),
        r.json("videos").alias("videos_json"),
        r.text("store").alias("store"),
        r.json("categories").alias("categories_json"),
        r.json("details").alias("details_json"),
        r.json("bought_together").alias("bought_together_json"),
        r.first_of("brand", "Brand").alias("brand"),
        r.first_of("color", "Color").alias("color"),
        r.first_of("marketplace", "locale", "product_locale").alias("product_locale"),
    )


def normalize_reviews(records: DataFrame, compat: bool = False, epoch_unit: str = "s") -> DataFrame:
    """N10. ``compat`` treats a vote count of 0 and an unverified purchase as missing."""
    r = record_of(REVIEW_KEYS)
    when_keys = ("timestamp", "unixReviewTime", "reviewTime")
    keep = not compat
    ts_text = r.first_of(*when_keys, keep_falsy=keep)
    ts_number = r.first_of(*when_keys, read=r.is_number, keep_falsy=keep)
    flag = r.first_of("verified_purchase", "verified", keep_falsy=keep)
    votes = r.first_of("helpful_vote", "helpful", read=r.number_text, keep_falsy=keep)
    return records.select(
        r.text("parent_asin").alias("parent_asin"),
        to_float(r.number_text("rating")).alias("rating"),
        r.text("title").alias("review_title"),
        r.text("text").alias("review_text"),
        r.json("images").alias("images_json"),
        r.first_of("user_id", "user", "reviewerID").alias("user_id"),
        clean_timestamp(ts_text, F.coalesce(ts_number, F.lit(False)), epoch_unit).alias("review_ts"),
        to_int(votes).alias("helpful_vote"),
        to_bool01(flag).alias("verified_purchase"),
        r.first_of("marketplace", "locale").alias("marketplace"),
        r.first_of("category", "main_category").alias("category"),
    )
