"""Benchmark tables in the roles of products, reviews and judged queries.

Each function has a SQL twin, used as a common table expression in the SQL texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.session import deal


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with long texts, over all cores."""
    return deal(table(spark, sf, name))


def products(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` as the product table."""
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lit("P"), text("p_partkey")).alias("parent_asin"),
        F.col("p_type").alias("main_category"),
        F.when(F.col("p_size") > 25, F.col("p_name"))
        .otherwise(F.concat_ws(" ", "p_type", "p_name")).alias("product_title"),
        (F.col("p_size") / F.lit(10.0)).alias("average_rating"),
        F.col("p_size").cast("bigint").alias("rating_number"),
        F.concat(F.lit('["'), F.col("p_name"), F.lit('","Made by '), F.col("p_brand"),
                 F.lit('","size '), text("p_size"), F.lit('"]')).alias("features_json"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("store"),
        F.concat(F.lit('{"Brand":"'), F.col("p_brand"), F.lit('","Type":"'), F.col("p_type"),
                 F.lit('","Box":{"Size":'), text("p_size"), F.lit(',"Sold":true}}'))
        .alias("details_json"),
        F.lit(None).cast("string").alias("filters_json"),
    )


PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, 'P' || p_partkey AS parent_asin, p_type AS main_category,
    CASE WHEN p_size > 25 THEN p_name ELSE p_type || ' ' || p_name END AS product_title,
    p_size / 10.0::DOUBLE AS average_rating, p_size::BIGINT AS rating_number,
    '["' || p_name || '","Made by ' || p_brand || '","size ' || p_size || '"]' AS features_json,
    p_retailprice AS price, p_brand AS store,
    '{"Brand":"' || p_brand || '","Type":"' || p_type || '","Box":{"Size":' || p_size
      || ',"Sold":true}}' AS details_json,
    NULL::VARCHAR AS filters_json
  FROM part)"""


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """``products``, those of one category under keys that no query names and no review has."""
    first = F.when(F.col("main_category") == "STANDARD", "N").otherwise("P")
    return products(spark, sf).withColumn(
        "parent_asin", F.concat(first, F.col("product_id").cast("string")))


CATALOGUE = PRODUCTS.replace(
    "'P' || p_partkey AS", "CASE WHEN p_type = 'STANDARD' THEN 'N' ELSE 'P' END || p_partkey AS")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as judged queries; returned lines form the reduced set."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("l_linestatus").alias("split"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("small_version"))


JUDGED = """judged AS (
  SELECT l_orderkey AS query_id, l_linenumber AS line, 'P' || l_partkey AS product_id,
    l_linestatus AS split, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS small_version
  FROM lineitem)"""


def line_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as reviews of parts; the quantity counts as votes."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("parent_asin"),
        F.col("l_quantity").cast("bigint").alias("helpful_vote"),
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("review_title"), F.col("l_linestatus").alias("review_text"))


LINE_REVIEWS = """reviews AS (
  SELECT 'P' || l_partkey AS parent_asin, l_quantity::BIGINT AS helpful_vote, l_orderkey,
    l_linenumber, l_returnflag AS review_title, l_linestatus AS review_text
  FROM lineitem)"""


def text_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as review texts; the turn counts as votes."""
    return texts(spark, sf, "conversations").select(
        F.concat(F.lit("P"), F.col("conv_id").cast("string")).alias("parent_asin"),
        F.col("turn").alias("helpful_vote"), F.col("role").alias("review_title"),
        F.col("text").alias("review_text"))


TEXT_REVIEWS = """reviews AS (
  SELECT 'P' || conv_id AS parent_asin, turn AS helpful_vote, role AS review_title,
    text AS review_text
  FROM conversations)"""


def text_products(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as products whose key is shared by all texts of a source."""
    return texts(spark, sf, "documents").select(
        F.col("doc_id").alias("product_id"), F.col("source").alias("parent_asin"),
        F.col("text").alias("product_title"),
        F.to_json(F.array("text")).alias("features_json"))


TEXT_PRODUCTS = """products AS (
  SELECT doc_id AS product_id, source AS parent_asin, text AS product_title,
    to_json([text])::VARCHAR AS features_json
  FROM documents)"""

# Search tokens of a text, as SQL; {} is the column.
SQL_TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
