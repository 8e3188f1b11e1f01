"""Duplicate-key audits: documents by source, key = digest of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.catalog.standins import table
from shelfmark.operators import audit as dup
from shelfmark.session import new_folder
from shelfmark.sources.tables import read_key_columns, read_table


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of source files; rows in French lack the key."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").alias("position"),
        F.when(F.col("lang") != "fr", F.md5(F.col("text").cast("binary"))).alias("key"))


_KEYS = """keys AS (SELECT source AS file, doc_id AS position, CASE WHEN lang <> 'fr' THEN md5(text) END AS key
  FROM documents),
counts AS (SELECT file, key, count(*) AS n, min(position) AS first FROM keys WHERE key IS NOT NULL GROUP BY file, key)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """D1."""
    return dup.file_stats(_keys(spark, sf))


_FILES = f"""
WITH {_KEYS}
SELECT file, count(key) AS rows_with_key, count(*) - count(key) AS rows_missing_key,
  (SELECT count(*) FROM counts c WHERE c.file = keys.file AND n > 1) AS duplicate_keys
FROM keys GROUP BY file
"""


def cross(spark: SparkSession, sf: str) -> DataFrame:
    """D2, A5."""
    return dup.cross_file(dup.key_counts(_keys(spark, sf)))


_CROSS_CTE = """across AS (SELECT key, count(*) AS n_files, sum(n)::BIGINT AS n_rows,
  string_agg(file, ';' ORDER BY file) AS files,
  string_agg(file || ':' || n, ';' ORDER BY file) AS counts_by_file
  FROM counts GROUP BY key HAVING count(*) >= 2)"""

_CROSS = f"WITH {_KEYS}, {_CROSS_CTE} SELECT * FROM across"


def within(spark: SparkSession, sf: str) -> DataFrame:
    """D3, A4."""
    return dup.within_file(dup.key_counts(_keys(spark, sf)))


_WITHIN = f"WITH {_KEYS} SELECT file, key, n FROM counts WHERE n > 1"


def report(spark: SparkSession, sf: str) -> DataFrame:
    """The report written as CSV and read back."""
    folder = new_folder(spark, "report")
    dup.write_report(dup.duplicate_report(dup.key_counts(_keys(spark, sf))), folder)
    return spark.read.csv(folder, header=True)


_REPORT = f"""
WITH {_KEYS}, {_CROSS_CTE}
SELECT 'cross_file' AS section, key AS product_id, files, counts_by_file FROM across
UNION ALL SELECT 'within_file', key, file, n::VARCHAR FROM counts WHERE n > 1
"""


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """D5."""
    return dup.summary(_keys(spark, sf))


_SUMMARY = f"""
WITH {_KEYS}, {_CROSS_CTE}
SELECT (SELECT count(DISTINCT file) FROM keys) AS files, (SELECT count(*) FROM keys) AS total_rows,
  (SELECT count(DISTINCT key) FROM counts) AS unique_keys,
  (SELECT count(*) FROM across) AS cross_file_keys,
  (SELECT count(*) FROM counts WHERE n > 1) AS within_file_keys
"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """The ten cross-file keys that are seen first."""
    return dup.cross_file_examples(dup.key_counts(_keys(spark, sf)), 10)


_EXAMPLES = f"""
WITH {_KEYS}, {_CROSS_CTE},
seen AS (SELECT key, min({{'f': file, 'p': first}}) AS place FROM counts GROUP BY key)
SELECT across.* FROM across JOIN seen USING (key) ORDER BY place, key LIMIT 10
"""


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Keys read by column name from many CSV files with two delimiters, whose names repeat
    from folder to folder; padded keys are trimmed, blanks count as missing."""
    folder = new_folder(spark, "keys-csv")
    rows = _keys(spark, sf).select("file", "position", F.concat(F.lit(" "), "key").alias("id"))
    for sep, part in ((",", 0), (";", 1)):
        (rows.filter(F.pmod("position", F.lit(2)) == part).write.partitionBy("file")
         .csv(f"{folder}/{part}", header=True, sep=sep, ignoreLeadingWhiteSpace=False))
    keys = read_key_columns(spark, [f"{folder}/0", f"{folder}/1"], "id", require_key=True)
    return dup.summary(keys.withColumn("file", F.element_at(F.split("file", "/"), -2)))


def union_files(spark: SparkSession, sf: str) -> DataFrame:
    """One table per source, read as one."""
    folder = new_folder(spark, "sources")
    table(spark, sf, "documents").select("doc_id", "lang", "source").write.partitionBy(
        "source").parquet(folder)
    return read_table(spark, folder).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


_UNION_FILES = "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL"

QUERIES = {
    "q_dup_files": files, "q_dup_cross": cross, "q_dup_within": within, "q_dup_report": report,
    "q_dup_summary": summary, "q_dup_examples": examples, "q_key_scan": scanned,
    "q_union_files": union_files,
}

SQL = {
    "q_dup_files": _FILES, "q_dup_cross": _CROSS, "q_dup_within": _WITHIN,
    "q_dup_report": _REPORT, "q_dup_summary": _SUMMARY, "q_dup_examples": _EXAMPLES,
    "q_key_scan": _SUMMARY, "q_union_files": _UNION_FILES,
}
