"""Query and product selection, profiles and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.catalog.standins import (CATALOGUE, JUDGED, LINE_REVIEWS, PRODUCTS, catalogue,
                                        judged, line_reviews, products, table, texts)
from shelfmark.functions.clean import is_empty
from shelfmark.operators import selection as sel
from shelfmark.operators.embedding import top_reviews
from shelfmark.operators.language import train_profiles, with_english
from shelfmark.operators.profile import fill_rates, schema_report
from shelfmark.operators.ranges import describe
from shelfmark.session import stage


def subset_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left after each filter, from one pass. Sixth lines have no key,
    seventh lines an empty one."""
    key = F.when(F.col("line") == 7, "").when(F.col("line") != 6, F.col("product_id"))
    flagged = judged(spark, sf).select(
        (F.col("small_version") == 1).alias("small"), sel.filled(key).alias("has_key"),
        (F.col("split") == "F").alias("first_split"))
    return sel.step_report(flagged, ["small", "has_key", "first_split"])


_SUBSET_STEPS = f"""
WITH {JUDGED}, n AS (SELECT count(*) AS a, count(*) FILTER (small_version = 1) AS b,
  count(*) FILTER (small_version = 1 AND line < 6) AS c,
  count(*) FILTER (small_version = 1 AND line < 6 AND split = 'F') AS d FROM judged)
SELECT 1 AS step, 'small' AS step_name, a AS before, b AS after, a - b AS removed FROM n
UNION ALL SELECT 2, 'has_key', b, c, b - c FROM n
UNION ALL SELECT 3, 'first_split', c, d, c - d FROM n
"""


def semi_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Reduced queries whose product is in the catalogue; some ask for unknown keys."""
    kept = sel.queries_with_product(sel.subset(judged(spark, sf)), catalogue(spark, sf))
    return kept.select("query_id", "line", "product_id", "split")


_SEMI_QUERIES = f"""
WITH {CATALOGUE}, {JUDGED}
SELECT query_id, line, product_id, split FROM judged WHERE small_version = 1 AND product_id IN
  (SELECT parent_asin FROM products)
"""


def interest(spark: SparkSession, sf: str) -> DataFrame:
    """Products judged by a query of the reduced set; some are judged by none."""
    found = sel.products_of_interest(catalogue(spark, sf), sel.subset(judged(spark, sf)))
    return found.select("product_id", "parent_asin", "product_title")


_INTEREST = f"""
WITH {CATALOGUE}, {JUDGED}
SELECT product_id, parent_asin, product_title FROM products WHERE parent_asin IN
  (SELECT product_id FROM judged WHERE small_version = 1)
"""


def in_list(spark: SparkSession, sf: str) -> DataFrame:
    """F2, A1: number of products in listed categories."""
    return sel.count_rows(products(spark, sf), ["ECONOMY", "LARGE"])


_IN_LIST = "SELECT count(*) AS rows FROM part WHERE p_type IN ('ECONOMY', 'LARGE')"


def exact_fold(spark: SparkSession, sf: str) -> DataFrame:
    """equality without regard to case, for every category, as an equi-join."""
    wanted = products(spark, sf).select(F.lower("main_category").alias("wanted")).distinct()
    rows = products(spark, sf)
    return (rows.join(wanted, sel.same_text(F.col("main_category"), F.col("wanted")))
            .groupBy("wanted").agg(F.count(F.lit(1)).alias("n")))


_EXACT_FOLD = "SELECT lower(p_type) AS wanted, count(*) AS n FROM part GROUP BY 1"


def between(spark: SparkSession, sf: str) -> DataFrame:
    """closed numeric range; reaches the Parquet scan."""
    return table(spark, sf, "part").filter(F.col("p_retailprice").between(950.0, 1000.0)) \
        .select("p_partkey", "p_retailprice")


_BETWEEN = "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1000"


def _with_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the different empty values, by language."""
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(lang == "de", " \t\n ").when(lang == "fr", "[]").when(lang == "es", " NULL ")
        .otherwise(F.col("text")).alias("text"),
        F.when(lang == "en", F.lit("NaN").cast("double")).otherwise(F.col("n_chars"))
        .cast("double").alias("size"),
        F.when(lang == "de", F.lit(None)).when(lang == "fr", "[ ]").otherwise("0")
        .cast("string").alias("note"))


_BLANKS = """blanks AS (
  SELECT doc_id, lang = 'en' AS text_full, lang <> 'en' AS size_full, lang <> 'de' AS note_full
  FROM documents)"""


def empty_values(spark: SparkSession, sf: str) -> DataFrame:
    """F8 per cell."""
    rows = _with_blanks(spark, sf)
    return rows.select("doc_id", is_empty(F.col("text")).alias("text_empty"),
                       is_empty(F.col("size"), numeric=True).alias("size_empty"),
                       is_empty(F.col("note")).alias("note_empty"))


_EMPTY_VALUES = f"""
WITH {_BLANKS} SELECT doc_id, NOT text_full AS text_empty, NOT size_full AS size_empty,
  NOT note_full AS note_empty FROM blanks
"""


def fill_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A7, P1."""
    return fill_rates(_with_blanks(spark, sf))


_FILL_RATE = f"""
WITH {_BLANKS}, n AS (SELECT count(*) AS rows, count(*) FILTER (text_full) AS t,
  count(*) FILTER (size_full) AS s, count(*) FILTER (note_full) AS o FROM blanks),
l AS (SELECT 'doc_id' AS "column", rows, rows AS filled FROM n
  UNION ALL SELECT 'text', rows, t FROM n UNION ALL SELECT 'size', rows, s FROM n
  UNION ALL SELECT 'note', rows, o FROM n)
SELECT "column", rows, filled, round((filled * 100)::DECIMAL(20, 6) / rows, 2)::DOUBLE
  AS percentage FROM l
"""


def schema_info(spark: SparkSession, sf: str) -> DataFrame:
    """P3."""
    return schema_report(_with_blanks(spark, sf))


_SCHEMA_INFO = """
SELECT 'doc_id' AS "column", 'bigint' AS type, count(*) AS non_null FROM documents
UNION ALL SELECT 'text', 'string', count(*) FROM documents
UNION ALL SELECT 'size', 'double', count(*) FROM documents
UNION ALL SELECT 'note', 'string', count(*) FILTER (lang <> 'de') FROM documents
"""


def describe_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A6, P2."""
    rows = products(spark, sf).select("average_rating", "rating_number", "price")
    wide = describe(rows, rows.columns)
    return wide.select("filter_column", "count", *[
        F.round(F.col(c), 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


_DESCRIBE = f"""
WITH {PRODUCTS}, v AS (
  SELECT 'average_rating' AS filter_column, average_rating AS x FROM products
  UNION ALL SELECT 'rating_number', rating_number::DOUBLE FROM products
  UNION ALL SELECT 'price', price FROM products)
SELECT filter_column, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
  round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75,
  round(max(x), 6) AS max
FROM v GROUP BY 1
"""


def topk_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The five most voted lines of each part."""
    ties = [F.col("l_orderkey"), F.col("l_linenumber")]
    top = top_reviews(line_reviews(spark, sf), k=5, ties=ties)
    return top.select("parent_asin", "rank", "helpful_vote", "l_orderkey", "l_linenumber")


_TOPK_REVIEWS = f"""
WITH {LINE_REVIEWS}
SELECT parent_asin, (row_number() OVER w)::INTEGER AS rank, helpful_vote, l_orderkey, l_linenumber
FROM reviews WINDOW w AS (PARTITION BY parent_asin
  ORDER BY helpful_vote DESC, l_orderkey, l_linenumber)
QUALIFY rank <= 5
"""


def page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of products in key order."""
    return sel.page(products(spark, sf), 50, 50, categories=["PROMO", "LARGE"]).select(
        "product_id", "main_category")


_PAGE = f"""
WITH {PRODUCTS}
SELECT product_id, main_category FROM products WHERE main_category IN ('PROMO', 'LARGE')
ORDER BY product_id LIMIT 50 OFFSET 50
"""


def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """R2 for bulk work: all pages at once, from the dense key."""
    return products(spark, sf).groupBy(sel.page_of(F.col("product_id"), 512).alias("page")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("product_id").alias("first"),
        F.max("product_id").alias("last"))


_PAGE_SIZES = """
SELECT p_partkey // 512 AS page, count(*) AS rows, min(p_partkey) AS first, max(p_partkey) AS last
FROM part GROUP BY 1
"""


def english(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles from the labelled documents, applied to all conversation texts."""
    profiles = stage(train_profiles(texts(spark, sf, "documents")), "profiles")
    asked = texts(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), "text")
    return with_english(asked, "id", "text", profiles).select(
        "id.conv_id", "id.turn", "is_english")


_WORDS = "unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word"

_ENGLISH = f"""
WITH vocabulary AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (
  SELECT DISTINCT word FROM (SELECT {_WORDS} FROM documents UNION ALL
    SELECT {_WORDS} FROM conversations))),
chars AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS c
  FROM (SELECT id, string_split(' ' || word || ' ', '') AS l FROM vocabulary)),
parts AS (SELECT id, c, lead(c, 1) OVER w AS d, lead(c, 2) OVER w AS e FROM chars
  WINDOW w AS (PARTITION BY id ORDER BY i)),
grams AS MATERIALIZED (SELECT word, gram FROM (
    SELECT id, unnest([c, c || d, c || d || e]) AS gram FROM parts) JOIN vocabulary USING (id)
  WHERE gram <> ' '),
counts AS (SELECT lang, gram, sum(n) AS n FROM (
    SELECT lang, word, count(*) AS n FROM (SELECT lang, {_WORDS} FROM documents) GROUP BY ALL)
  JOIN grams USING (word) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1),
profile AS (SELECT lang, gram, round(ln(n / total) * 1000)::BIGINT + 14000 AS gain
  FROM counts JOIN totals USING (lang)),
scores AS (SELECT conv_id, turn, lang, sum(gain) AS score
  FROM (SELECT conv_id, turn, {_WORDS} FROM conversations) JOIN grams USING (word)
  JOIN profile USING (gram) GROUP BY ALL),
best AS (SELECT conv_id, turn, arg_min(lang, (-score, lang)) AS lang FROM scores GROUP BY ALL)
SELECT conv_id, turn, coalesce(best.lang = 'en', false) AS is_english
FROM conversations LEFT JOIN best USING (conv_id, turn)
"""


QUERIES = {
    "q_subset_steps": subset_steps, "q_semi_queries": semi_queries,
    "q_products_of_interest": interest, "q_in_list": in_list, "q_exact_fold": exact_fold,
    "q_between": between, "q_empty_values": empty_values, "q_fill_rate": fill_rate,
    "q_schema_info": schema_info, "q_describe": describe_columns,
    "q_topk_reviews": topk_reviews, "q_page": page, "q_page_sizes": page_sizes,
    "q_english": english,
}

SQL = {
    "q_subset_steps": _SUBSET_STEPS, "q_semi_queries": _SEMI_QUERIES,
    "q_products_of_interest": _INTEREST, "q_in_list": _IN_LIST, "q_exact_fold": _EXACT_FOLD,
    "q_between": _BETWEEN, "q_empty_values": _EMPTY_VALUES, "q_fill_rate": _FILL_RATE,
    "q_schema_info": _SCHEMA_INFO, "q_describe": _DESCRIBE, "q_topk_reviews": _TOPK_REVIEWS,
    "q_page": _PAGE, "q_page_sizes": _PAGE_SIZES, "q_english": _ENGLISH,
}
