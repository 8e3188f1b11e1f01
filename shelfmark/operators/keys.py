"""Dense surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from shelfmark.session import stage
from shelfmark.sources.jsonl import POSITION


def dense_ids(rows: DataFrame, id_column: str, first: int = 0) -> DataFrame:
    """Number rows 0..n-1 in file path order, then line order. Rows are not shuffled to be numbered.

    ``rows`` carries the position columns of the scan. Within a file block the sequence number
    grows by one per row, so a row's rank in its block is its distance from the block's first
    number. Only the block table is summed up: first inside each file, then over the files, of
    which there are no more than the driver's own file listing holds. The rows are staged before,
    because the numbers must be the same in both passes, also after a lost task.
    """
    placed = stage(rows, "numbered")
    blocks = placed.groupBy("src_path", "src_block").agg(
        F.min("src_seq").alias("block_first"), F.count(F.lit(1)).alias("block_rows"))
    in_file = W.partitionBy("src_path").orderBy("src_block").rowsBetween(
        W.unboundedPreceding, -1)
    over_files = W.orderBy("src_path").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("src_path").agg(F.sum("block_rows").alias("file_rows")).withColumn(
        "file_start", F.coalesce(F.sum("file_rows").over(over_files), F.lit(0)))
    starts = (
        blocks.withColumn("block_start",
                          F.coalesce(F.sum("block_rows").over(in_file), F.lit(0)))
        .join(files, "src_path")
        .select("src_path", "src_block",
                (F.col("file_start") + F.col("block_start") - F.col("block_first") + first)
                .alias("shift"))
    )
    numbered = placed.join(starts, ["src_path", "src_block"]).withColumn(
        id_column, (F.col("src_seq") + F.col("shift")).cast("bigint"))
    return numbered.drop("shift", *POSITION)
