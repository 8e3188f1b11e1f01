"""Filter documents (S7, W4): read entries back for the table update, write nested JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.sources.chunks import JSON_ARRAY, pieces, records, split_starts

_ENTRY = "product_id STRING, filters STRING"


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, position, element)``: the objects in files that hold one JSON array each, as JSON text.

    A file is read by as many tasks as it has splits, whether it has line breaks or not. Elements
    that are no objects are left out; a file that is not one complete array is refused.
    """
    found = pieces(spark, path, JSON_ARRAY.separator)
    starts = split_starts(found, JSON_ARRAY)
    # the piece behind the last brace counts as ended by one, so a complete array ends at depth -1
    whole = ((F.col("first") == "[") & (F.col("end_last") == "]") & (F.col("end_bit") == 0)
             & (F.col("end_depth") == -1))
    bad = starts.filter(~F.coalesce(whole, F.lit(False))).select("file").first()
    if bad is not None or starts.isEmpty():
        raise ValueError(f"{bad['file'] if bad else path}: expected a JSON array of objects")
    cut = records(found, starts, JSON_ARRAY).filter("closed")
    # whatever stands before the object since the last one is read with it and left out
    before = F.regexp_replace("text", "^[\\s\ufeff]*[\\[,]", "")
    listed = F.from_json(F.concat(F.lit("["), before, F.lit("}]")), "array<string>")
    return cut.select("file", "position", F.try_element_at(listed, F.lit(-1)).alias("element"))


def read_filter_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(product_id, filters, position)`` with ``filters`` as JSON text, in document order.

    ``lines`` reads one object per line; otherwise every file is one JSON array. Both are split
    across tasks. A document that is not an array is refused.
    """
    if lines:
        entries = spark.read.schema(_ENTRY).json(path)
        place = F.struct(F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("row"))
    else:
        entries = read_json_array(spark, path).withColumn("e", F.from_json("element", _ENTRY))
        entries = entries.select("file", "position", "e.*")
        place = F.struct(F.col("file").alias("path"), "position.block", "position.row")
    # The reader keeps the line breaks of the document; a second look writes the array compactly.
    compact = F.from_json(F.concat(F.lit('{"f":'), F.col("filters"), F.lit("}")), "f STRING")["f"]
    return entries.select("product_id", F.coalesce(compact, F.col("filters")).alias("filters"),
                          place.alias("position"))


def filter_entry_json(f: Column) -> Column:
    """One filter with the keys and value shape of the exported documents.

    The value is a string, or ``[min, max]`` for a range; counts columns hold whole numbers.
    """
    bounds = F.when(f["filter_column"] == "rating_number",
                    F.to_json(F.array(f["min"].cast("bigint"), f["max"].cast("bigint")))) \
        .otherwise(F.to_json(F.array(f["min"], f["max"])))
    quoted = F.to_json(F.to_variant_object(F.array(f["value"])))
    value = F.when(f["filter_type"] == "range", bounds) \
        .otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.struct(
        f["filter_column"].alias("filter_column"),
        F.parse_json(value).alias("filter_value"),
        f["total_in_db"].alias("total_in_db"),
        f["match_count"].alias("match_count"),
        f["match_percentage"].alias("match_percentage"),
    )


def filters_json(filters: Column) -> Column:
    """A filter array as JSON text."""
    return F.to_json(F.transform(filters, filter_entry_json))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is no JSON value."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def write_filter_lines(df: DataFrame, path: str, filters: str = "filters") -> None:
    """One JSON object per line: the product columns and its filter array."""
    nested = nan_to_null(df).withColumn(
        filters, F.transform(F.coalesce(F.col(filters), F.array()), filter_entry_json))
    nested.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, one_line: bool = False) -> None:
    """The rows as JSON arrays, one array per file: every task adds the brackets of its own file.
    With ``one_line`` a file holds no line break. A task without rows writes no file."""
    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"value": [(mark if i == 0 else ",") + r for i, r in enumerate(rows)]})
            mark = "," if rows else mark
        yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]})

    rows = nan_to_null(df).select(F.to_json(F.struct("*")).alias("value"))
    writer = rows.mapInArrow(bracketed, "value string").write.mode("overwrite")
    writer.option("lineSep", " " if one_line else "\n").text(path)
