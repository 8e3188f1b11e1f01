"""Judged queries: reduced set, product exists, text is English."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.language import with_english
from shelfmark.operators.selection import queries_with_product, subset
from shelfmark.session import stage
from shelfmark.sources.tables import write_csv


def english_only(queries: DataFrame, profiles: DataFrame | None = None, text: str = "query"
                 ) -> DataFrame:
    """T7 on queries: each distinct text is judged once."""
    texts = queries.select(text).filter(F.col(text).isNotNull()).distinct()
    english = with_english(texts.withColumn("text_key", F.col(text)), "text_key", text, profiles)
    kept = english.filter("is_english").select(text)
    return queries.join(kept, text, "left_semi").select(*queries.columns)


def select_queries(examples: DataFrame, products: DataFrame,
                   profiles: DataFrame | None = None) -> DataFrame:
    """The queries that the dataset keeps."""
    reduced = subset(examples, "small_version", 1)
    return english_only(queries_with_product(reduced, products), profiles)


def build_queries(examples: DataFrame, products: DataFrame, out: str,
                  profiles: DataFrame | None = None) -> DataFrame:
    """Write the kept queries as CSV and return the rows left after each step."""
    spark = examples.sparkSession
    reduced = subset(examples, "small_version", 1)
    known = stage(queries_with_product(reduced, products), "known-queries")
    kept = stage(english_only(known, profiles), "english-queries")
    written = write_csv(kept, out)
    before, after = reduced.count(), known.count()
    return spark.createDataFrame(
        [(1, "product exists", before, after, before - after),
         (2, "english", after, written, after - written)],
        "step int, step_name string, before long, after long, removed long")
