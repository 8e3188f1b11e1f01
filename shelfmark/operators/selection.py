"""Choosing queries and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import by_merge


def subset(queries: DataFrame, column: str = "small_version", value=1) -> DataFrame:
    """the reduced query set; the comparison reaches the Parquet scan."""
    return queries.filter(F.col(column) == value)


def in_list(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """membership in a literal list; no list keeps all rows."""
    return df.filter(F.col(column).isin(values)) if values else df


def filled(column: Column) -> Column:
    """neither NULL nor the empty text."""
    return column.isNotNull() & (column != "")


def same_text(a: Column, b: Column) -> Column:
    """equality without regard to case."""
    return F.lower(a) == F.lower(b)


def distinct_keys(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """A3: distinct filled keys, as a DataFrame."""
    name = alias or column
    return df.select(F.col(column).alias(name)).filter(filled(F.col(name))).distinct()


def queries_with_product(queries: DataFrame, products: DataFrame, query_key: str = "product_id",
                         product_key: str = "parent_asin") -> DataFrame:
    """Queries whose judged product exists."""
    keys = distinct_keys(products, product_key, query_key)
    return queries.join(by_merge(keys), query_key, "left_semi").select(*queries.columns)


def products_of_interest(products: DataFrame, queries: DataFrame, query_key: str = "product_id",
                         product_key: str = "parent_asin") -> DataFrame:
    """Products judged by at least one query."""
    keys = distinct_keys(queries, query_key, product_key)
    return products.join(by_merge(keys), product_key, "left_semi").select(*products.columns)


def step_report(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """rows before and after each of several filters applied in turn, in one pass.

    ``flags`` are boolean columns. One row per step: ``step, step_name, before, after, removed``.
    """
    kept = [F.count(F.lit(1)).alias("kept_0")]
    condition = F.lit(True)
    for i, flag in enumerate(flags, 1):
        condition = condition & F.coalesce(F.col(flag), F.lit(False))
        kept.append(F.count_if(condition).alias(f"kept_{i}"))
    steps = F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(flag).alias("step_name"),
                 F.col(f"kept_{i - 1}").alias("before"), F.col(f"kept_{i}").alias("after"))
        for i, flag in enumerate(flags, 1)])).alias("s")
    return (flagged.agg(*kept).select(steps).select("s.*")
            .withColumn("removed", F.col("before") - F.col("after")))


def keep_flagged(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """Rows that pass all flags, without the helper columns."""
    kept = flagged
    for flag in flags:
        kept = kept.filter(F.col(flag))
    return kept.drop(*flags)


def count_rows(df: DataFrame, categories: list[str] | None = None,
               column: str = "main_category") -> DataFrame:
    """A1: number of rows, optionally of some categories."""
    return in_list(df, column, categories).agg(F.count(F.lit(1)).alias("rows"))


def page(df: DataFrame, start: int, limit: int, key: str = "product_id",
         categories: list[str] | None = None) -> DataFrame:
    """R2: one page in key order. For bulk work use ``page_of`` on dense keys instead of paging."""
    return in_list(df, "main_category", categories).orderBy(key).offset(start).limit(limit)


def page_of(key: Column, page_size: int) -> Column:
    """The page a dense key falls on, without sorting."""
    return F.floor(key / F.lit(page_size)).cast("bigint")
