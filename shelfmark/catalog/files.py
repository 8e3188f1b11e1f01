"""Files: arrays and multi-line CSV that are split, pages through an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.catalog.standins import PRODUCTS, products, table
from shelfmark.operators.selection import count_rows
from shelfmark.schemas import _struct, _L, _S
from shelfmark.session import new_folder
from shelfmark.sources.filters import read_json_array, write_json_arrays
from shelfmark.sources.pages import read_page, write_paged
from shelfmark.sources.tables import read_csv, read_key_column, write_csv


def json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as nested objects in JSON arrays without line breaks, markup and scripts included."""
    folder = new_folder(spark, "pages-array")
    pages = table(spark, sf, "pages")
    nested = F.struct("html", F.array(F.struct(F.lit("}{\\\"[").alias("mark"), "url")).alias("links"))
    write_json_arrays(pages.select("page_id", nested.alias("body")), folder, one_line=True)
    back = read_json_array(spark, folder).select(F.from_json(
        "element", "page_id bigint, body struct<html: string, "
                   "links: array<struct<mark: string, url: string>>>").alias("e"))
    return back.select("e.page_id", F.md5(F.col("e.body.html").cast("binary")).alias("html_md5"),
                       F.col("e.body.links")[0]["url"].alias("url"),
                       F.col("e.body.links")[0]["mark"].alias("mark"))


_JSON_ARRAY = r"""
SELECT page_id, md5(html) AS html_md5, url, '}{\"[' AS mark FROM pages
"""


def csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks, quotes and separators in quoted cells, and the keys beside."""
    folder = new_folder(spark, "documents-multiline")
    hostile = F.concat(F.lit('"a,"\n'), "text", F.lit('",\n\n"",x\n"'))
    write_csv(table(spark, sf, "documents").select("source", hostile.alias("text"), "doc_id"), folder)
    rows = read_csv(spark, folder, _struct(source=_S, text=_S, doc_id=_L))
    keys = read_key_column(spark, folder, "doc_id").select(F.col("key").cast("bigint").alias("doc_id"))
    return rows.join(keys, "doc_id").select(
        "doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_CSV_MULTILINE = """
SELECT doc_id, source, md5('"a,"' || chr(10) || text || '",' || chr(10) || chr(10) || '"",x' || chr(10)
  || '"') AS text_md5 FROM documents
"""

def far_page(spark: SparkSession, sf: str) -> DataFrame:
    """R2: a page at three quarters of two categories, through the page index."""
    folder, kinds = new_folder(spark, "paged"), ["PROMO", "SMALL"]
    rows = products(spark, sf).select("product_id", "main_category", "product_title")
    write_paged(rows, folder, "product_id", 512, group="main_category")
    total = count_rows(rows, kinds).first()["rows"]
    return read_page(spark, folder, "product_id", 3 * total // 4, 100, kinds, "main_category")


_FAR_PAGE = f"""
WITH {PRODUCTS},
placed AS (SELECT product_id, main_category, product_title, count(*) OVER () AS total,
    row_number() OVER (ORDER BY product_id) AS place
  FROM products WHERE main_category IN ('PROMO', 'SMALL'))
SELECT product_id, main_category, product_title FROM placed
WHERE place > 3 * total // 4 AND place <= 3 * total // 4 + 100
"""

QUERIES = {"q_far_page": far_page, "q_json_array": json_array, "q_csv_multiline": csv_multiline}

SQL = {"q_far_page": _FAR_PAGE, "q_json_array": _JSON_ARRAY, "q_csv_multiline": _CSV_MULTILINE}
