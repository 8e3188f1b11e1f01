"""Typed tables (S3-S6, S8, U1, U2, W2, W3, W5-W8): Parquet between steps, CSV at the edges."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from shelfmark.functions.text import strip
from shelfmark.sources.chunks import csv_lines, pieces, records, split_starts

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
_CELLS = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
DELIMITERS = [",", ";", "\t", "|"]


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A Parquet table or a folder of shards."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def csv_records(spark: SparkSession, paths: str | list[str], schema: T.StructType,
                sep: str = ",") -> DataFrame:
    """``(file, position, cells)``: the rows of CSV files with a header. Cells may hold line breaks;
    a file is still read by as many tasks as it has splits.

    Rows end with LF or CRLF. Blank rows are dropped, as is the first row of each file.
    """
    form = csv_lines(sep)
    found = pieces(spark, paths, form.separator)
    rows = records(found, split_starts(found, form), form)
    rows = rows.filter((F.col("position.block") > 0) | (F.col("position.row") > 0))
    text = F.regexp_replace("text", "\r$", "")
    cells = F.from_csv(text, _ddl(schema), {**_CELLS, "sep": sep})
    return rows.filter(text != "").select("file", "position", cells.alias("cells"))


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType,
             single_line: bool = False) -> DataFrame:
    """CSV files with a header as one table of the declared types.

    Empty cells are NULL. Quoted cells may hold line breaks; ``single_line`` saves the pass that
    finds out where rows begin, for files that are known to hold none.
    """
    if not single_line:
        return csv_records(spark, paths, schema).select("cells.*")
    return spark.read.schema(schema).options(**{**_CSV, "multiLine": False}).csv(paths)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types found by a pass over the data."""
    return spark.read.options(**_CSV, inferSchema=True).csv(path)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}"
                     for f in schema.fields)


def _delimiter_in(header: str) -> str:
    """The delimiter seen most often outside quotes; a comma when there is none."""
    bare = re.sub(r'"[^"]*"', "", header)
    best, index = max((bare.count(d), -i) for i, d in enumerate(DELIMITERS))
    return DELIMITERS[-index] if best else ","


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header line to the files that have it, found by one job however many files there are.

    The driver gets one line per file. Files without any line are left out.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    first = (lines.select(F.col("_metadata.file_path").alias("path"), "value",
                          F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("row"))
             .filter(F.col("block") == 0).groupBy("path")
             .agg(F.min_by("value", "row").alias("header")).orderBy("path"))
    found: dict[str, list[str]] = {}
    for r in first.collect():
        found.setdefault(r["header"].removeprefix("\ufeff"), []).append(unquote(r["path"]))
    return found


def csv_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of the header line of a CSV file."""
    return _delimiter_in(next(iter(csv_headers(spark, [path])), ""))


def read_key_columns(spark: SparkSession, paths: list[str], key: str, require_key: bool = False,
                     delimiter: str | None = None, single_line: bool = False) -> DataFrame:
    """``(file, position, key)`` for every row of CSV files, one scan per distinct header.

    ``file`` is the whole path, ``position`` orders the rows of a file, the key is trimmed and
    blank is NULL. Files without the key column give NULL keys, or fail with ``require_key``.
    Rows are split across tasks; ``single_line`` saves a pass over files without line breaks in
    cells.
    """
    united = spark.createDataFrame([], "file string, position struct<block: bigint, row: bigint>, "
                                       "key string")
    for header, files in csv_headers(spark, paths).items():
        sep = delimiter or _delimiter_in(header)
        names = next(csv.reader([header], delimiter=sep), [])
        if require_key and key not in names:
            raise ValueError(f"{files[0]}: no column {key!r} in {names}")
        if single_line:
            rows = spark.read.options(**{**_CSV, "multiLine": False}, sep=sep).csv(files)
            cell = F.col(f"`{key}`") if key in names else F.lit(None)
            rows = rows.select(F.col("_metadata.file_path").alias("file"),
                               F.struct(F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("row"))
                               .alias("position"), cell.alias("cell"))
        else:
            # by place, so that names that repeat or clash do no harm
            cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
            cell = F.col(f"cells.c{names.index(key)}") if key in names else F.lit(None)
            rows = csv_records(spark, files, cells, sep).select("file", "position", cell.alias("cell"))
        value = F.nullif(strip(F.col("cell").cast("string")), F.lit(""))
        united = united.unionByName(rows.select("file", "position", value.alias("key")))
    return united


def read_key_column(spark: SparkSession, path: str, key: str, require_key: bool = False,
                    delimiter: str | None = None, single_line: bool = False) -> DataFrame:
    """S6 for one file or folder."""
    return read_key_columns(spark, [path], key, require_key, delimiter, single_line)


def pick_columns(df: DataFrame, columns: list[str] | T.StructType) -> DataFrame:
    """The listed columns in order; missing ones are NULL."""
    if isinstance(columns, T.StructType):
        return df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in columns.fields])
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> int:
    """CSV with a header; returns the rows written, counted during the write.

    Time stamps are written as ``yyyy-MM-dd HH:mm:ss``; NULL is an empty cell.
    """
    rows = pick_columns(df, columns) if columns else df
    seen = Observation()
    (rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return seen.get["rows"]


def lost_by_typing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per column, the filled cells that the declared type cannot hold. One pass."""
    present = [f for f in schema.fields if f.name in df.columns]
    lost = [F.count_if(strip(F.col(f.name).cast("string")).isNotNull()
                       & (strip(F.col(f.name).cast("string")) != "")
                       & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
            for f in present]
    counts = df.agg(*lost)
    return counts.unpivot([], [f.name for f in present], "column", "lost_values")


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None,
                partition_by: list[str] | None = None) -> DataFrame:
    """Replace a table as a whole with rows of the declared types, and read it back."""
    rows = df
    if schema is not None:
        rows = df.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_shards(df: DataFrame, path: str, key: str, rows_per_file: int,
                 partitions: int | None = None) -> None:
    """Range-partitioned files of at most ``rows_per_file`` rows, sorted by ``key``."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).parquet(path))


def compact_shards(spark: SparkSession, shards: str, out: str, files: int,
                   vector: str = "vector", key: str | None = None) -> DataFrame:
    """Rewrite many small shards as few files, in order of ``key`` if given. All vectors must
    have one length; nothing is written otherwise."""
    table = spark.read.parquet(shards)
    low, high = table.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors differ in length: {low} to {high}")
    few = (table.repartitionByRange(files, key).sortWithinPartitions(key) if key
           else table.repartition(files))
    few.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
