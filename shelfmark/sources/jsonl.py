"""JSON lines (S1, S2): tolerant scan, reject report and file routing.

Each line is parsed once, into the keys that the tables need. All values arrive as text; what JSON
type a text had is asked for later, and only where the text leaves it open.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.constants import PRODUCT_FILE_PREFIX
from shelfmark.functions.clean import Record
from shelfmark.functions.text import strip

# Where a row came from. The sequence number grows with the line number inside one file block.
POSITION = ["src_path", "src_block", "src_seq"]


@dataclass(frozen=True)
class Keys:
    """Keys to read: plain ones as text, containers as JSON text, typed ones as variants."""

    plain: tuple[str, ...]
    containers: tuple[str, ...] = ()
    typed: tuple[str, ...] = ()
    names: dict[str, str] = field(init=False, default_factory=dict)

    def __post_init__(self):
        # Column names that stay apart without regard to case.
        for i, key in enumerate((*self.plain, *self.containers, *self.typed)):
            self.names[key] = f"k{i}_{key.lower()}"

    def schema(self, named: bool, end: str) -> T.ArrayType:
        kinds = {key: T.VariantType() if key in self.typed else T.StringType()
                 for key in self.names}
        fields = [T.StructField(self.names[k] if named else k, t) for k, t in kinds.items()]
        return T.ArrayType(T.StructType([*fields, T.StructField(end, T.StringType())]))


PRODUCT_KEYS = Keys(
    plain=("parent_asin", "main_category", "title", "average_rating", "rating_number", "price",
           "store", "brand", "Brand", "color", "Color", "marketplace", "locale",
           "product_locale"),
    containers=("features", "description", "images", "videos", "categories", "details",
                "bought_together"))

REVIEW_KEYS = Keys(
    plain=("parent_asin", "rating", "title", "text", "user_id", "user", "reviewerID",
           "helpful_vote", "helpful", "verified_purchase", "verified", "marketplace", "locale",
           "category", "main_category"),
    containers=("images",),
    typed=("timestamp", "unixReviewTime", "reviewTime"))


def is_product_file(file_name: Column) -> Column:
    """Product metadata files carry a prefix, all others hold reviews."""
    return file_name.startswith(PRODUCT_FILE_PREFIX)


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """Non-blank lines with the file and block they came from; files split across tasks."""
    lines = (
        spark.read.option("pathGlobFilter", glob).text(path)
        .select(
            strip(F.col("value")).alias("line"),
            F.col("_metadata.file_path").alias("src_path"),
            F.col("_metadata.file_name").alias("src_file"),
            F.col("_metadata.file_block_start").alias("src_block"),
        )
    )
    return lines.filter(F.col("line") != "")


def parse_lines(lines: DataFrame, keys: Keys) -> DataFrame:
    """Add ``fields`` (the values of ``keys``) and ``kept``, false where the line is no JSON object.

    A repeated key keeps its last value. The parser stops behind the first complete value, so an
    end mark is put behind the line: only a line that is one object and nothing else leads to it.
    The parse runs inside a generator, because a plain column would be parsed again by each filter
    that is pushed below it.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    end = f"end_{uuid.uuid4().hex}"
    marked = F.concat(F.lit("["), F.col("line"), F.lit(f',{{"{end}":"1"}}]'))
    parsed = F.from_json(marked, keys.schema(False, end), {"allowSingleQuotes": "false"})
    return (lines.withColumn("parsed", F.explode(F.array(parsed)))
            .withColumn("parsed", F.col("parsed").cast(keys.schema(True, end)))
            .withColumn("kept", F.coalesce(F.col("line").startswith("{")
                                           & (F.size("parsed") == 2)
                                           & (F.col("parsed")[1][end] == "1"), F.lit(False)))
            .withColumn("fields", F.col("parsed")[0]).drop("parsed"))


def valid_records(parsed: DataFrame) -> DataFrame:
    """Parsed objects only, numbered inside their block."""
    return parsed.filter("kept").withColumn("src_seq", F.monotonically_increasing_id())


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """Malformed lines, for a side table."""
    return parsed.filter(~F.col("kept")).select("src_path", "line")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Lines read, kept and skipped per file."""
    return parsed.groupBy("src_file").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("kept")).alias("kept"),
        F.count_if(~F.col("kept")).alias("skipped"),
    )


def record_of(keys: Keys) -> Record:
    """Access to the parsed keys of a row."""
    return Record(F.col("line"), {k: F.col("fields")[name] for k, name in keys.names.items()},
                  keys.typed)
