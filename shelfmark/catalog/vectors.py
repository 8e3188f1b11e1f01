"""Product documents, token windows, vectors and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.catalog.standins import (CATALOGUE, SQL_TOKENS, TEXT_REVIEWS, catalogue, table,
                                        text_reviews, texts)
from shelfmark.functions.vector import l2_norm, l2_normalize, to_float32, zero_if_missing
from shelfmark.operators.embedding import (masked_mean, mean_vectors, not_yet_done,
                                           product_documents, product_vectors, token_windows)
from shelfmark.session import new_folder
from shelfmark.sources.tables import compact_shards, read_table, write_shards

_DIM = 64


def product_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Product text with its reviews, digest and length. Products without reviews have
    nothing but a title here, so the short ones go."""
    ties = [F.col("review_title"), F.col("review_text")]
    described = F.col("main_category") != "STANDARD"
    rows = catalogue(spark, sf).withColumns(
        {c: F.when(described, F.col(c)) for c in ("features_json", "details_json")})
    docs = product_documents(rows, text_reviews(spark, sf), ties=ties)
    return docs.select("product_id", "parent_asin",
                       F.char_length("document").cast("bigint").alias("n_chars"),
                       F.md5(F.col("document").cast("binary")).alias("digest"))


_SPACES = "' ' || chr(9) || chr(10) || chr(13)"

_PRODUCT_DOC = f"""
WITH {CATALOGUE}, {TEXT_REVIEWS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_asin
    ORDER BY helpful_vote DESC, review_title, review_text) AS rank FROM reviews),
parts AS (
  SELECT product_id, 0 AS a, 0 AS b, product_title AS piece FROM products
  UNION ALL SELECT product_id, 0, 1, features_json FROM products WHERE main_category <> 'STANDARD'
  UNION ALL SELECT product_id, 0, 2, details_json FROM products WHERE main_category <> 'STANDARD'
  UNION ALL SELECT product_id, rank, 0, review_title FROM products JOIN ranked
    USING (parent_asin) WHERE rank <= 20
  UNION ALL SELECT product_id, rank, 1, review_text FROM products JOIN ranked
    USING (parent_asin) WHERE rank <= 20),
docs AS (SELECT product_id, string_agg(trim(piece, {_SPACES}), chr(10) ORDER BY a, b) AS document
  FROM parts WHERE trim(piece, {_SPACES}) <> '' GROUP BY 1)
SELECT product_id, parent_asin, length(document) AS n_chars, md5(document) AS digest
FROM docs JOIN products USING (product_id) WHERE length(document) >= 20
"""


def window_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping token windows of every document."""
    rows = token_windows(texts(spark, sf, "documents"), ["doc_id"], "text")
    return rows.select("doc_id", "window", F.size("tokens").cast("bigint").alias("n"),
                       F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


_WINDOWS = f"""windows AS (
  SELECT doc_id, (s // 52)::INTEGER AS "window", t[s + 1 : s + 62] AS toks
  FROM (SELECT doc_id, t, unnest(generate_series(0,
      (greatest(len(t) - 62, 0) + 51) // 52 * 52, 52)) AS s
    FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents)))"""

_WINDOW_ROWS = f"""
WITH {_WINDOWS}
SELECT doc_id, "window", len(toks)::BIGINT AS n, md5(array_to_string(toks, ' ')) AS digest
FROM windows
"""


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One vector per document by the default encoder, one row per dimension."""
    docs = texts(spark, sf, "documents").select(
        F.col("doc_id").alias("product_id"), F.col("source").alias("parent_asin"),
        F.col("text").alias("document"))
    found = product_vectors(docs, dim=_DIM)
    return found.select("product_id", F.posexplode("vector").alias("dim", "x")).select(
        "product_id", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))


_VECTOR_ROWS = f"""
WITH {_WINDOWS},
words AS (SELECT doc_id, "window", len(toks) AS n, md5(unnest(toks)) AS h FROM windows),
coded AS (SELECT doc_id, "window", n, (('0x' || h[1:8])::BIGINT % {_DIM})::INTEGER AS dim,
    CASE WHEN h[9:9] >= '8' THEN -1 ELSE 1 END AS sign FROM words),
pooled AS (SELECT doc_id, "window", dim, sum(sign) / any_value(n)::DOUBLE AS x FROM coded
  GROUP BY doc_id, "window", dim),
sizes AS (SELECT doc_id, count(*) AS windows FROM windows GROUP BY 1),
mean AS (SELECT doc_id, dim, sum(x) / any_value(windows) AS x FROM pooled JOIN sizes USING (doc_id)
  GROUP BY 1, 2),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM mean GROUP BY 1)
SELECT s.doc_id AS product_id, d.dim::INTEGER AS dim,
  round((CASE WHEN norm >= 1e-12 THEN coalesce(x, 0) / norm ELSE coalesce(x, 0) END)
    ::FLOAT::DOUBLE, 5) + 0.0 AS x
FROM sizes s CROSS JOIN range({_DIM}) d(dim) LEFT JOIN mean m ON m.doc_id = s.doc_id
  AND m.dim = d.dim LEFT JOIN norms ON norms.doc_id = s.doc_id
"""


def vector_mean(spark: SparkSession, sf: str) -> DataFrame:
    """E5, A10: element-wise mean per label."""
    mean = mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding")
    return mean.select("label", F.posexplode("embedding").alias("dim", "x")).select(
        "label", "dim", F.round("x", 6).alias("x"))


_VECTOR_MEAN = """
SELECT label, (i - 1)::INTEGER AS dim, round(avg(x), 6) AS x FROM (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
  FROM embeddings) GROUP BY ALL
"""


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """Masked mean per label over the vectors with a positive first element."""
    rows = table(spark, sf, "embeddings").withColumn(
        "mask", F.when((F.col("label") == 0) | (F.get("embedding", F.lit(0)) > 0), 1).otherwise(0))
    pooled = masked_mean(rows, ["label"], "embedding", "mask")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select(
        "label", "dim", F.round("x", 6).alias("x"))


_MASKED = """
SELECT label, (i - 1)::INTEGER AS dim,
  round(sum(x * mask) / greatest(sum(mask), 1e-6::DOUBLE), 6) AS x FROM (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x,
    CASE WHEN label = 0 OR embedding[1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask
  FROM embeddings) GROUP BY ALL
"""


def l2(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors; zero vectors stay, missing vectors become zero vectors."""
    rows = table(spark, sf, "embeddings")
    vector = (F.when(F.col("label") == 1, F.array_repeat(F.lit(0.0), _DIM))
              .when(F.col("label") == 2, F.lit(None)).otherwise(F.col("embedding")
                                                               .cast("array<double>")))
    unit = rows.select("vec_id", l2_normalize(zero_if_missing(vector, _DIM)).alias("v"))
    return unit.select("vec_id", F.size(to_float32(F.col("v"))).cast("bigint").alias("dim"),
                       F.round(l2_norm(F.col("v")), 6).alias("norm"),
                       F.round(F.get("v", F.lit(0)), 6).alias("first"))


_L2 = """
SELECT vec_id, 64::BIGINT AS dim, CASE WHEN label IN (1, 2) THEN 0.0::DOUBLE ELSE 1.0 END AS norm,
  CASE WHEN label IN (1, 2) THEN 0.0::DOUBLE ELSE round(embedding[1]::DOUBLE /
    sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])), 6) END AS first
FROM embeddings
"""


def shards(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written in two runs of shards, compacted into one table."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("product_id"), F.col("label").cast("string").alias("parent_asin"),
        to_float32(F.col("embedding")).alias("vector"))
    parts, out = new_folder(spark, "shards"), new_folder(spark, "compact")
    write_shards(rows.filter(F.col("parent_asin") < "5"), f"{parts}/run=1", "product_id", 64)
    left = not_yet_done(rows, read_table(spark, parts))
    write_shards(left, f"{parts}/run=2", "product_id", 64)
    whole = compact_shards(spark, parts, out, 2, key="product_id")
    return whole.select("product_id", "parent_asin", F.size("vector").cast("bigint").alias("dim"),
                        F.get("vector", F.lit(0)).cast("double").alias("first"))


_SHARDS = """
SELECT vec_id AS product_id, label::VARCHAR AS parent_asin, len(embedding) AS dim,
  embedding[1]::DOUBLE AS first FROM embeddings
"""

QUERIES = {
    "q_product_doc": product_doc, "q_windows": window_rows, "q_vectors": vector_rows,
    "q_vector_mean": vector_mean, "q_masked_mean": masked, "q_l2": l2, "q_shards": shards,
}

SQL = {
    "q_product_doc": _PRODUCT_DOC, "q_windows": _WINDOW_ROWS, "q_vectors": _VECTOR_ROWS,
    "q_vector_mean": _VECTOR_MEAN, "q_masked_mean": _MASKED, "q_l2": _L2, "q_shards": _SHARDS,
}
