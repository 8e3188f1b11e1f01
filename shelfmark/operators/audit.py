"""Duplicate-key audit over files.

Input is ``(file, key)``, one row per table row, key NULL when missing; ``position``, where given,
orders the rows of a file. A file is known by its whole path and shown by its name, so files of one
name in two folders stay apart. Everything follows from the
count per (file, key), which is aggregated before its shuffle, so a key that fills a third of the
rows is one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.constants import DUPLICATE_COLUMNS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def key_counts(keys: DataFrame) -> DataFrame:
    """A4: rows per file and key, and where the key is ``first`` seen if rows have a position."""
    first = [F.min("position").alias("first")] if "position" in keys.columns else []
    return keys.filter(F.col("key").isNotNull()).groupBy("file", "key").agg(
        F.count(F.lit(1)).alias("n"), *first)


def file_stats(keys: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per file the rows with key, rows without, and keys that occur more than once."""
    counts = key_counts(keys) if counts is None else counts
    missing = keys.groupBy("file").agg(
        F.count("key").alias("rows_with_key"),
        F.count_if(F.col("key").isNull()).alias("rows_missing_key"))
    repeated = counts.groupBy("file").agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    return missing.join(repeated, "file", "left").select(
        file_name(F.col("file")).alias("file"), "rows_with_key", "rows_missing_key",
        F.coalesce("duplicate_keys", F.lit(0)).alias("duplicate_keys"))


def _listing(pairs: Column) -> tuple[Column, Column]:
    files = F.array_join(F.transform(pairs, lambda p: file_name(p["file"])), ";")
    counts = F.array_join(F.transform(pairs, lambda p: F.concat(
        file_name(p["file"]), F.lit(":"), p["n"].cast("string"))), ";")
    return files.alias("files"), counts.alias("counts_by_file")


def _across(counts: DataFrame, *more: Column) -> DataFrame:
    per_key = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct("file", "n"))).alias("pairs"), *more)
    return per_key.filter(F.col("n_files") >= 2)


def cross_file(counts: DataFrame) -> DataFrame:
    """Keys in two or more files, with the files in path order and their counts.

    A list holds at most one entry per file.
    """
    return _across(counts).select("key", "n_files", "n_rows", *_listing(F.col("pairs")))


def within_file(counts: DataFrame) -> DataFrame:
    """D3: keys repeated inside one file."""
    return counts.filter(F.col("n") > 1).select(file_name(F.col("file")).alias("file"), "key", "n")


def duplicate_report(counts: DataFrame) -> DataFrame:
    """Both sections in the columns of the report file."""
    across = cross_file(counts).select(F.lit("cross_file").alias("section"),
                                       F.col("key").alias("product_id"), "files",
                                       "counts_by_file")
    inside = within_file(counts).select(F.lit("within_file").alias("section"),
                                        F.col("key").alias("product_id"),
                                        F.col("file").alias("files"),
                                        F.col("n").cast("string").alias("counts_by_file"))
    return across.unionByName(inside).select(*DUPLICATE_COLUMNS)


def write_report(report: DataFrame, path: str) -> None:
    """The report as sorted CSV, cross-file keys first; a range sort, not one task."""
    within_by_file = F.when(F.col("section") == "within_file", F.col("files")).otherwise(F.lit(""))
    report.orderBy("section", within_by_file, "product_id").write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)


def summary(keys: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row of totals."""
    counts = key_counts(keys) if counts is None else counts
    rows = keys.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("file").alias("files"))
    # Three levels: (file, key), key, total. Nothing is collected.
    per_key = counts.groupBy("key").agg(F.count(F.lit(1)).alias("n_files"),
                                        F.count_if(F.col("n") > 1).alias("repeated"))
    totals = per_key.agg(F.count(F.lit(1)).alias("unique_keys"),
                         F.count_if(F.col("n_files") >= 2).alias("cross_file_keys"),
                         F.coalesce(F.sum("repeated"), F.lit(0)).alias("within_file_keys"))
    names = ["files", "total_rows", "unique_keys", "cross_file_keys", "within_file_keys"]
    return rows.unionByName(totals, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in names])


def cross_file_examples(counts: DataFrame, limit: int = 10) -> DataFrame:
    """The cross-file keys that are seen first, files in path order and rows in file order.

    Only the best rows of each task reach the result. ``counts`` comes from rows with a position.
    """
    seen = _across(counts, F.min(F.struct("file", "first")).alias("seen"))
    return (seen.orderBy("seen", "key").limit(limit)
            .select("key", "n_files", "n_rows", *_listing(F.col("pairs"))))
