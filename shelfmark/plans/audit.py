"""Duplicate-key audit of CSV files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import audit
from shelfmark.session import stage
from shelfmark.sources.tables import read_key_columns


@dataclass
class Audit:
    summary: DataFrame
    files: DataFrame
    examples: DataFrame
    report: DataFrame


def audit_keys(keys: DataFrame) -> Audit:
    """All reports from ``(file, position, key)`` rows."""
    counts = stage(audit.key_counts(keys), "key-counts")
    return Audit(audit.summary(keys, counts), audit.file_stats(keys, counts),
                 audit.cross_file_examples(counts), audit.duplicate_report(counts))


def audit_files(spark: SparkSession, paths: list[str], key: str = "product_id",
                require_key: bool = False, delimiter: str | None = None,
                report: str | None = None, single_line: bool = False) -> Audit:
    """Audit CSV files on any key column; optionally write the report."""
    keys = stage(read_key_columns(spark, paths, key, require_key, delimiter, single_line), "keys")
    result = audit_keys(keys)
    if report:
        audit.write_report(result.report, report)
    return result
