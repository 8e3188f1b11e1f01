"""Pages of an ordered table without sorting what lies before them (R2).

The table is written in key order, in files of a bounded number of rows. A small index beside it has,
per file and group, the first key and the number of rows; running counts over it tell which files
hold a page, and only these are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def write_paged(rows: DataFrame, path: str, key: str, rows_per_file: int,
                group: str | None = None, partitions: int | None = None) -> None:
    """``path/rows`` in order of ``key`` and ``path/index``. ``key`` must name each row; ``group``
    is a column that pages may be restricted to."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions, key) if partitions else rows.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows"))
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    index = (written.withColumn("file", F.col("_metadata.file_name"))
             .groupBy("file", (F.col(group) if group else F.lit(None)).cast("string").alias("grp"))
             .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("rows")))
    index.write.mode("overwrite").parquet(f"{path}/index")


def files_of_page(spark: SparkSession, path: str, offset: int, limit: int,
                  groups: list[str] | None = None) -> tuple[list[str], int]:
    """Names of the files that hold the page, and the rows of them before it.

    One row per file passes through one task; the driver gets the files of the page.
    """
    index = spark.read.parquet(f"{path}/index")
    if groups is not None:
        index = index.filter(F.col("grp").isin(groups))
    files = index.groupBy("file").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
    order = Window.orderBy("first", "file")
    placed = files.withColumn("upto", F.sum("rows").over(order))
    page = (placed.filter((F.col("upto") > offset) & (F.col("upto") - F.col("rows") < offset + limit))
            .orderBy("upto").collect())
    return [r.file for r in page], offset - (page[0].upto - page[0].rows) if page else 0


def read_page(spark: SparkSession, path: str, key: str, offset: int, limit: int,
              groups: list[str] | None = None, group: str | None = None) -> DataFrame:
    """R2: ``limit`` rows from row ``offset`` on, in order of ``key``; of the rows whose ``group`` is
    one of ``groups`` if these are given."""
    files, skip = files_of_page(spark, path, offset, limit, groups)
    table = spark.read.parquet(f"{path}/rows")
    if not files or limit <= 0:
        return table.limit(0)
    rows = spark.read.schema(table.schema).parquet(*[f"{path}/rows/{f}" for f in files])
    if groups is not None:
        rows = rows.filter(F.col(group).cast("string").isin(groups))
    return rows.orderBy(key).offset(skip).limit(limit)
