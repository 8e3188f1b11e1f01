"""Review files that keep arriving, cleaned by the same expressions as a batch run.

Cleaning is row by row, so it needs no state and no watermark. Product rows are left to batch runs,
because their dense numbering needs all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.constants import PRODUCT_FILE_PREFIX
from shelfmark.functions.text import strip
from shelfmark.operators.records import normalize_reviews
from shelfmark.sources.jsonl import REVIEW_KEYS, parse_lines


def stream_reviews(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Cleaned reviews from the review files of a growing folder."""
    lines = (spark.readStream.option("pathGlobFilter", "*.jsonl")
             .option("maxFilesPerTrigger", files_per_trigger).text(folder)
             .select(strip(F.col("value")).alias("line"),
                     F.col("_metadata.file_name").alias("src_file"))
             .filter((F.col("line") != "") & ~F.col("src_file").startswith(PRODUCT_FILE_PREFIX)))
    return normalize_reviews(parse_lines(lines, REVIEW_KEYS).filter("kept"))


def append_reviews(spark: SparkSession, folder: str, table: str,
                   checkpoint: str) -> StreamingQuery:
    """Append all files that are new since the last run, then stop."""
    return (stream_reviews(spark, folder).writeStream.format("parquet")
            .option("checkpointLocation", checkpoint).option("path", table)
            .trigger(availableNow=True).start())
