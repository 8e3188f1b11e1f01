"""Tokens, postings, phrases, JSON leaves and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.catalog.filters import _sql_entities, _sql_phrase
from shelfmark.catalog.standins import PRODUCTS, SQL_TOKENS, products, table, texts
from shelfmark.functions.text import (NO_TOKENS, entity_phrases, json_leaves, padded, strip,
                                      tokens)
from shelfmark.operators.phrases import phrase_counts, phrase_matches, postings, search_bodies
from shelfmark.operators.stored_index import (block_stats, decode_blocks, encode_blocks, lookup,
                                              store_index)
from shelfmark.session import new_folder, stage
from shelfmark.sources.tables import write_table


def token_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Number of search tokens and their digest per document."""
    toks = texts(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("bigint").alias("n"),
                       F.md5(F.array_join("t", "|").cast("binary")).alias("digest"))


_TOKEN_LISTS = f"""
SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS digest
FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents)
"""


def _document_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return search_bodies(texts(spark, sf, "documents"), "doc_id", ["text"])


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index in coded blocks, written by field and read back, with documents per
    token."""
    written = write_table(encode_blocks(_document_bodies(spark, sf)), new_folder(spark, "postings"),
                          partition_by=["field"])
    return block_stats(written)


_INDEX = f"""
SELECT 'text' AS field, token, count(DISTINCT doc_id) AS documents, count(*) AS occurrences
FROM (SELECT doc_id, unnest({SQL_TOKENS.format('text')}) AS token FROM documents) GROUP BY token
"""


def posting_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All positions of the index over the documents."""
    return postings(_document_bodies(spark, sf))


_POSTING_ROWS = f"""
SELECT 'text' AS field, token, doc_id AS row_id, (i - 1)::INTEGER AS pos FROM (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i
  FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents))
"""


def posting_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index, its delta-coded blocks decoded again."""
    stored = store_index(_document_bodies(spark, sf), new_folder(spark, "stored-index"))
    return decode_blocks(stored.table(stored.blocks))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole passage and every sentence of the benchmark as a phrase."""
    rows = texts(spark, sf, "benchmark")
    sentences = F.split("text", r"[.!?\n]+")
    listed = rows.select(F.explode(F.concat(F.array("text"), sentences)).alias("raw"))
    return (listed.select(F.lit("text").alias("field"), padded(tokens(F.col("raw")))
                          .alias("phrase"))
            .filter(F.col("phrase") != NO_TOKENS).distinct())


_PASSAGES = f"""phrases AS (SELECT DISTINCT phrase FROM (
  SELECT {_sql_phrase('raw')} AS phrase FROM (
    SELECT text AS raw FROM benchmark
    UNION ALL SELECT unnest(regexp_split_to_array(text, '[.!?\\n]+')) FROM benchmark))
  WHERE phrase <> '  '),
bodies AS (SELECT doc_id, {_sql_phrase('text')} AS body FROM documents)"""


def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark passage or sentence."""
    bodies = stage(_document_bodies(spark, sf), "bodies")
    found = phrase_matches(bodies, stage(_passages(spark, sf), "phrases"))
    return found.select(F.md5(F.col("phrase").cast("binary")).alias("phrase_md5"),
                        F.col("row_id").alias("doc_id"))


_PHRASE_MATCH = f"""
WITH {_PASSAGES}
SELECT md5(phrase) AS phrase_md5, doc_id FROM phrases JOIN bodies ON contains(body, phrase)
"""


def phrase_count(spark: SparkSession, sf: str) -> DataFrame:
    """T4: documents per passage or sentence, all phrases in one job."""
    bodies = stage(_document_bodies(spark, sf), "bodies")
    counts = phrase_counts(bodies, stage(_passages(spark, sf), "phrases"))
    return counts.select(F.md5(F.col("phrase").cast("binary")).alias("phrase_md5"), "match_count")


_PHRASE_COUNT = f"""
WITH {_PASSAGES}
SELECT md5(phrase) AS phrase_md5, count(*) AS match_count
FROM phrases JOIN bodies ON contains(body, phrase) GROUP BY 1
"""


def stored_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The same matches through the stored index."""
    stored = store_index(_document_bodies(spark, sf), new_folder(spark, "stored-index"))
    found = lookup(stored, _passages(spark, sf))
    return found.select(F.lower(F.hex("phrase_id")).alias("phrase_md5"), F.col("row_id").alias("doc_id"))


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    """T5: scalar values of the nested product details, any depth, in text order."""
    rows = products(spark, sf).select("product_id", json_leaves(F.col("details_json"))
                                      .alias("leaves"))
    return rows.select("product_id", F.posexplode("leaves").alias("pos", "leaf"))


_JSON_LEAVES = f"""
WITH {PRODUCTS}, interest AS (SELECT * FROM products),
leaves AS (SELECT product_id, j.id AS place, CASE WHEN j.atom::VARCHAR = 'true' THEN 'True'
    ELSE json_extract_string(j.atom, '$') END AS leaf
  FROM interest, json_tree(details_json) j WHERE j.atom IS NOT NULL)
SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY place) - 1)::INTEGER AS pos,
  leaf FROM leaves
"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity phrases of every document, by the default rule."""
    found = texts(spark, sf, "documents").select("doc_id", entity_phrases(F.col("text"))
                                                 .alias("e"))
    return found.select("doc_id", F.posexplode("e").alias("pos", "entity"))


_ENTITIES = f"""
SELECT doc_id, (i - 1)::INTEGER AS pos,
  entity
FROM (SELECT doc_id, unnest(e) AS entity, generate_subscripts(e, 1) AS i
  FROM (SELECT doc_id, {_sql_entities('text')} AS e FROM documents))
"""


def stripped(spark: SparkSession, sf: str) -> DataFrame:
    """Trim, case, replace, concatenate, extract."""
    rows = table(spark, sf, "pages")
    return rows.select(
        "page_id", strip(F.concat(F.lit("\t \n"), F.col("url"), F.lit("  "))).alias("trimmed"),
        F.upper("url").alias("upper"), F.replace("url", F.lit("http"), F.lit("")).alias("cut"),
        F.regexp_extract("url", r"//([^/:?#]+)", 1).alias("host"),
        F.concat_ws("|", "page_id", F.lower("url")).alias("joined"))


_STRIPPED = """
SELECT page_id, url AS trimmed, upper(url) AS upper, replace(url, 'http', '') AS cut,
  regexp_extract(url, '//([^/:?#]+)', 1) AS host, page_id || '|' || lower(url) AS joined
FROM pages
"""

QUERIES = {
    "q_tokens": token_lists, "q_index": index, "q_postings": posting_rows,
    "q_phrase_match": phrase_match, "q_phrase_count": phrase_count, "q_postings_blocks": posting_blocks,
    "q_stored_phrases": stored_phrases, "q_json_leaves": leaves,
    "q_entities": entities, "q_text_functions": stripped,
}

SQL = {
    "q_tokens": _TOKEN_LISTS, "q_index": _INDEX, "q_postings": _POSTING_ROWS,
    "q_phrase_match": _PHRASE_MATCH, "q_phrase_count": _PHRASE_COUNT, "q_postings_blocks": _POSTING_ROWS,
    "q_stored_phrases": _PHRASE_MATCH,
    "q_json_leaves": _JSON_LEAVES, "q_entities": _ENTITIES, "q_text_functions": _STRIPPED,
}
