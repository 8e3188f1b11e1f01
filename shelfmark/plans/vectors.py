"""One vector per product, restartable, in range-partitioned shards."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from shelfmark.constants import PAGE_SIZE
from shelfmark.operators.embedding import not_yet_done, product_documents, product_vectors
from shelfmark.operators.selection import in_list
from shelfmark.sources.tables import compact_shards


def finished(spark: SparkSession, shards: str) -> DataFrame | None:
    """Vectors already written, or None."""
    try:
        return spark.read.parquet(shards)
    except AnalysisException:
        return None


def build_vectors(products: DataFrame, reviews: DataFrame, shards: str,
                  categories: list[str] | None = None, page_size: int = PAGE_SIZE,
                  make_encoder=None, **options) -> DataFrame:
    """Add vectors for the products that have none yet; a second run adds nothing."""
    spark = products.sparkSession
    open_products = not_yet_done(in_list(products, "main_category", categories),
                                 finished(spark, shards))
    documents = product_documents(open_products, reviews, **options)
    vectors = product_vectors(documents, make_encoder)
    (vectors.repartitionByRange("product_id").sortWithinPartitions("product_id")
     .write.mode("append").option("maxRecordsPerFile", page_size).parquet(shards))
    return spark.read.parquet(shards)


def compact(spark: SparkSession, shards: str, out: str, files: int = 1) -> DataFrame:
    """The shards as one table."""
    return compact_shards(spark, shards, out, files, key="product_id")
