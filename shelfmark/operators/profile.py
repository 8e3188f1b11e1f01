"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.clean import is_empty
from shelfmark.operators.ranges import describe

__all__ = ["fill_rates", "schema_report", "describe"]

_FLOATS = ("double", "float")


def fill_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, non-empty cells and their share in percent per column, in one pass."""
    columns = columns or df.columns
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in _FLOATS}
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.count_if(~is_empty(F.col(c), c in numeric)).alias(c) for c in columns])
    long = counts.unpivot(["__rows"], columns, "column", "filled")
    share = F.round(F.col("filled").cast("decimal(20,0)") * 100 / F.col("__rows"), 2)
    return long.select("column", F.col("__rows").alias("rows"), "filled",
                       share.cast("double").alias("percentage"))


def schema_report(df: DataFrame) -> DataFrame:
    """Type and number of non-NULL cells per column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counts.unpivot([], df.columns, "column", "non_null").select(
        "column", names[F.col("column")].alias("type"), "non_null")
