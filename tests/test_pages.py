"""Pages through the index against OFFSET over the whole table."""

import pytest
from pyspark.sql import functions as F

from shelfmark.sources.pages import files_of_page, read_page, write_paged


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paged") / "t")
    rows = spark.range(0, 3000, 3).select(
        F.col("id").alias("key"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5)
        .cast("string").alias("kind"), F.concat(F.lit("v"), "id").alias("v"))
    write_paged(rows, path, "key", 64, group="kind", partitions=3)
    return path, sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("offset,limit", [(0, 10), (63, 2), (500, 100), (990, 50), (1000, 5), (5, 0)])
def test_pages(spark, paged, offset, limit):
    path, rows = paged
    assert list(map(tuple, read_page(spark, path, "key", offset, limit).collect())) == \
        rows[offset:offset + limit]
    few = [r for r in rows if r[1] in ("1", "4")]
    got = read_page(spark, path, "key", offset // 3, limit, ["1", "4"], "kind").collect()
    assert list(map(tuple, got)) == few[offset // 3:offset // 3 + limit]


def test_a_far_page_reads_its_files_only(spark, paged):
    path, rows = paged
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) >= 16
    files, skip = files_of_page(spark, path, 900, 20)
    assert len(files) <= 2 and 0 <= skip < 64
    assert len(read_page(spark, path, "key", 900, 20).inputFiles()) <= 2


def test_pages_of_an_empty_table(spark, tmp_path):
    write_paged(spark.range(0).withColumnRenamed("id", "key"), str(tmp_path / "e"), "key", 5)
    assert read_page(spark, str(tmp_path / "e"), "key", 0, 5).count() == 0
