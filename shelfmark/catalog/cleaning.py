"""Raw records: JSON lines, scalar cleaning, numbering, CSV and JSON round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.catalog.standins import PRODUCTS, products, table
from shelfmark.functions import clean
from shelfmark.operators.keys import dense_ids
from shelfmark.operators.records import normalize_products, normalize_reviews
from shelfmark.schemas import _struct, _D, _L, _S
from shelfmark.session import new_folder
from shelfmark.sources import jsonl
from shelfmark.sources.filters import read_filter_document
from shelfmark.sources.tables import (lost_by_typing, pick_columns, read_csv, read_csv_inferred,
                                      write_csv, write_table)


def _text(name: str):
    return F.col(name).cast("string")


def _since_epoch(unit: str):
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))


# --- JSON lines -----------------------------------------------------------------------------


def _part_lines(spark: SparkSession, sf: str) -> str:
    """Parts as JSON lines in key order: small parts are cut off (malformed), promotions follow a
    blank line."""
    line = F.concat(
        F.lit('{"parent_asin":"P'), _text("p_partkey"), F.lit('","title":"'), F.col("p_name"),
        F.lit('","main_category":"'), F.col("p_type"), F.lit('","average_rating":"'),
        _text("p_size"), F.lit('.5","rating_number":'), _text("p_size"),
        F.lit('.0,"price":"$1,'), F.lpad(_text("p_size"), 3, "0"),
        F.lit('.50","features":["'), F.col("p_name"), F.lit('",{"z":1,"a":[2,"x"]}],'
                                                            '"description":["'),
        F.col("p_name"), F.lit('",null,"'), F.col("p_brand"),
        F.lit('"],"details":{"Type":"'), F.col("p_type"), F.lit('","Brand":"'), F.col("p_brand"),
        F.lit('"},"images":null,"categories":[],"store":"'), F.col("p_brand"),
        F.lit('","brand":"","Brand":"'), F.col("p_brand"),
        F.lit('","color":"red","locale":"us","color":"blue"}'))
    shaped = (F.when(F.col("p_type") == "SMALL", F.substring(line, 1, 40))
              .when(F.col("p_type") == "PROMO", F.concat(F.lit("  \n\t"), line)).otherwise(line))
    folder = new_folder(spark, "part-lines")
    (table(spark, sf, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
     .select(shaped.alias("value")).write.text(folder))
    return folder


def jsonl_products(spark: SparkSession, sf: str) -> DataFrame:
    lines = jsonl.parse_lines(jsonl.read_lines(spark, _part_lines(spark, sf), "part-*"),
                              jsonl.PRODUCT_KEYS)
    rows = dense_ids(normalize_products(jsonl.valid_records(lines)), "product_id")
    return rows.drop("videos_json", "bought_together_json")


def jsonl_rejects(spark: SparkSession, sf: str) -> DataFrame:
    lines = jsonl.parse_lines(jsonl.read_lines(spark, _part_lines(spark, sf), "part-*"),
                              jsonl.PRODUCT_KEYS)
    return jsonl.reject_counts(lines).agg(
        F.sum("lines").alias("lines"), F.sum("kept").alias("kept"),
        F.sum("skipped").alias("skipped"))


_JSONL_PRODUCTS = """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS product_id, 'P' || p_partkey AS parent_asin,
  p_type AS main_category, p_name AS product_title, p_size + 0.5::DOUBLE AS average_rating,
  p_size::BIGINT AS rating_number, '["' || p_name || '",{"z":1,"a":[2,"x"]}]' AS features_json,
  p_name || chr(10) || p_brand AS product_description, 1000.5::DOUBLE + p_size AS price,
  NULL::VARCHAR AS images_json, p_brand AS store, '[]' AS categories_json,
  '{"Type":"' || p_type || '","Brand":"' || p_brand || '"}' AS details_json,
  p_brand AS brand, 'blue' AS color, 'us' AS product_locale
FROM part WHERE p_type <> 'SMALL'
"""

_JSONL_REJECTS = """
SELECT count(*) AS lines, count(*) FILTER (p_type <> 'SMALL') AS kept,
  count(*) FILTER (p_type = 'SMALL') AS skipped FROM part
"""


def jsonl_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Events as review lines; the shape of time stamp and flag depends on the event type."""
    stamp = (F.when(F.col("event_type") == "view", F.concat(
        F.lit('"timestamp":'), _since_epoch("SECOND").cast("string")))
        .when(F.col("event_type") == "click", F.concat(
            F.lit('"timestamp":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('"')))
        .when(F.col("event_type") == "error", F.concat(
            F.lit('"timestamp":"","reviewTime":"'),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+02:00"')))
        .otherwise(F.lit('"timestamp":null')))
    flag = (F.when(F.col("event_type") == "purchase", F.lit(',"verified_purchase":true'))
            .when(F.col("event_type") == "view", F.lit(',"verified_purchase":false'))
            .when(F.col("event_type") == "click", F.lit(',"verified":"Yes"')).otherwise(F.lit("")))
    line = F.concat(
        F.lit('{"event":'), _text("event_id"), F.lit(',"parent_asin":"P'), _text("user_id"),
        F.lit('","rating":'), F.get_json_object("props", "$.k"), F.lit(',"title":"'),
        F.col("event_type"), F.lit('","text":"caf\\u00e9 '), _text("event_id"),
        F.lit('","helpful_vote":'), F.get_json_object("props", "$.k"), F.lit(',"reviewerID":"u'),
        _text("user_id"), F.lit('",'), stamp, flag, F.lit("}"))
    folder = new_folder(spark, "event-lines")
    table(spark, sf, "events").select(line.alias("value")).write.text(folder)
    records = jsonl.valid_records(jsonl.parse_lines(
        jsonl.read_lines(spark, folder, "part-*"), jsonl.REVIEW_KEYS))
    return normalize_reviews(records).drop("images_json", "marketplace", "category")


_JSONL_REVIEWS = """
SELECT 'P' || user_id AS parent_asin, (props->>'k')::DOUBLE AS rating, event_type AS review_title,
  'café ' || event_id AS review_text, 'u' || user_id AS user_id,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN date_trunc('second', ts) END AS review_ts,
  (props->>'k')::BIGINT AS helpful_vote,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 1 END
    AS verified_purchase
FROM events
"""


# --- scalar cleaning --------------------------------------------------------------------------


def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """N1 over five spellings of each event time."""
    events = table(spark, sf, "events")
    spelled = {
        "full": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "iso_z": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "iso_offset": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'"),
        "day": F.date_format("ts", " yyyy-MM-dd "),
        "compact": F.date_format("ts", "yyyyMMdd"),
        "year": F.date_format("ts", "yyyy"),
        "words": F.date_format("ts", "MM dd, yyyy"),
    }
    epoch = _since_epoch("MICROSECOND").cast("double") / 1000000
    return events.select(
        "event_id", *[clean.clean_timestamp(c).alias(n) for n, c in spelled.items()],
        clean.clean_timestamp(epoch.cast("string"), F.lit(True)).alias("epoch"),
        clean.clean_timestamp((epoch * 1000).cast("string"), F.lit(True)).alias("epoch_millis"),
        clean.timestamp_text(clean.clean_timestamp(spelled["full"])).alias("as_text"))


_TIMESTAMPS = """
SELECT event_id, date_trunc('second', ts) AS full, date_trunc('second', ts) AS iso_z,
  date_trunc('second', ts) AS iso_offset, date_trunc('day', ts)::TIMESTAMP AS day,
  date_trunc('day', ts)::TIMESTAMP AS compact, NULL::TIMESTAMP AS year, NULL::TIMESTAMP AS words,
  date_trunc('second', ts) AS epoch, NULL::TIMESTAMP AS epoch_millis,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_text
FROM events
"""


def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """N3, N4, N16 on clean and dirty spellings."""
    part = table(spark, sf, "part")
    size = _text("p_size")
    return part.select(
        "p_partkey",
        clean.to_int(F.concat(F.lit(" "), size)).alias("int_plain"),
        clean.to_int(F.concat(size, F.lit(".9"))).alias("int_cut"),
        clean.to_int(F.concat(size, F.lit("e1"))).alias("int_exponent"),
        clean.to_int(F.col("p_name")).alias("int_words"),
        clean.to_float(_text("p_retailprice")).alias("float_plain"),
        clean.to_float(F.concat(size, F.lit("d"))).alias("float_suffix"),
        clean.to_float(F.lit("")).alias("float_blank"),
        clean.to_number(F.concat(size, F.lit(".25"))).alias("number"),
        clean.to_number(F.lit("nan")).alias("number_nan"))


_SAFE_NUMBERS = """
SELECT p_partkey, p_size::BIGINT AS int_plain, p_size::BIGINT AS int_cut,
  p_size::BIGINT * 10 AS int_exponent, NULL::BIGINT AS int_words, p_retailprice AS float_plain,
  NULL::DOUBLE AS float_suffix, NULL::DOUBLE AS float_blank, p_size + 0.25::DOUBLE AS number,
  NULL::DOUBLE AS number_nan
FROM part
"""


def price(spark: SparkSession, sf: str) -> DataFrame:
    """N5 on price texts."""
    size, cents = _text("p_size"), F.lpad(_text("p_size"), 2, "0")
    texts = {
        "dollars": F.concat(F.lit("$1,"), F.lpad(size, 3, "0"), F.lit(".50")),
        "cents": F.concat(F.lit("from ."), cents),
        "span": F.concat(size, F.lit(" - 90")),
        "negative": F.concat(F.lit("-"), size),
        "dash": F.lit("—"), "words": F.col("p_name"),
    }
    return table(spark, sf, "part").select(
        "p_partkey", *[clean.parse_price(c).alias(n) for n, c in texts.items()],
        clean.parse_price(_text("p_retailprice"), F.lit(True)).alias("number"))


_PRICE = """
SELECT p_partkey, 1000.5::DOUBLE + p_size AS dollars,
  ('.' || lpad(p_size::VARCHAR, 2, '0'))::DOUBLE AS cents, p_size::DOUBLE AS span,
  -p_size::DOUBLE AS negative, NULL::DOUBLE AS dash, NULL::DOUBLE AS words,
  p_retailprice AS number
FROM part
"""


def bool01(spark: SparkSession, sf: str) -> DataFrame:
    """N6 on line flags spelled in many ways."""
    lines = table(spark, sf, "lineitem")
    word = F.when(F.col("l_returnflag") == "R", " Yes ").when(F.col("l_returnflag") == "A", "nO") \
        .otherwise("maybe")
    letter = F.when(F.col("l_linestatus") == "F", "F").otherwise("T")
    return (lines.select(clean.to_bool01(word).alias("word"), clean.to_bool01(letter)
                         .alias("letter"), clean.to_bool01(F.lit("")).alias("blank"))
            .groupBy("word", "letter", "blank").agg(F.count(F.lit(1)).alias("n")))


_BOOL01 = """
SELECT CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS word,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS letter, NULL::INTEGER AS blank, count(*) AS n
FROM lineitem GROUP BY ALL
"""


def _event_records(spark: SparkSession, sf: str, body, keys: jsonl.Keys) -> DataFrame:
    lines = table(spark, sf, "events").select("event_id", "event_type", body.alias("line"))
    return jsonl.parse_lines(lines, keys).filter("kept")


def alt_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The first key with a value, in the plain and the strict form."""
    first = (F.when(F.col("event_type") == "view", '"a":""')
             .when(F.col("event_type") == "click", '"a":0')
             .when(F.col("event_type") == "error", '"a":"x"')
             .when(F.col("event_type") == "signup", '"a":[]').otherwise('"c":1'))
    keys = jsonl.Keys(plain=("a", "b", "c"))
    rows = _event_records(spark, sf, F.concat(F.lit("{"), first, F.lit(',"b":"'),
                                              _text("event_id"), F.lit('"}')), keys)
    r = jsonl.record_of(keys)
    return rows.select("event_id", r.first_of("a", "b").alias("strict"),
                       r.first_of("a", "b", keep_falsy=True).alias("plain"),
                       r.first_of("b", "a").alias("swapped"),
                       r.first_of("c", "a").alias("last_falsy"))


_ALT_KEYS = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' ELSE event_id::VARCHAR END AS strict,
  CASE event_type WHEN 'error' THEN 'x' WHEN 'click' THEN '0' WHEN 'signup' THEN '[]'
    ELSE event_id::VARCHAR END AS plain,
  event_id::VARCHAR AS swapped,
  CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN '0' WHEN 'error' THEN 'x'
    WHEN 'signup' THEN '[]' ELSE '1' END AS last_falsy
FROM events
"""


def description(spark: SparkSession, sf: str) -> DataFrame:
    """A field that is a list, an object, a text, a number or null."""
    k = F.get_json_object("props", "$.k")
    value = (F.when(F.col("event_type") == "view", F.concat(F.lit('["a",null,'), k, F.lit("]")))
             .when(F.col("event_type") == "click", F.concat(F.lit('{"z":'), k, F.lit(',"a":[]}')))
             .when(F.col("event_type") == "error", F.lit('"it\'s \\"quoted\\""'))
             .when(F.col("event_type") == "signup", k).otherwise(F.lit("null")))
    keys = jsonl.Keys(plain=(), containers=("description",))
    rows = _event_records(spark, sf, F.concat(F.lit('{"description":'), value, F.lit("}")), keys)
    r = jsonl.record_of(keys)
    return rows.select("event_id", r.joined("description").alias("flat"),
                       r.json("description").alias("json_text"),
                       clean.blank_to_empty(r.joined("description")).alias("not_null"))


_DESCRIPTION = """
WITH d AS (SELECT event_id, event_type, props->>'k' AS k,
  CASE event_type WHEN 'view' THEN 'a' || chr(10) || (props->>'k')
    WHEN 'click' THEN '{"z":' || (props->>'k') || ',"a":[]}'
    WHEN 'error' THEN 'it''s "quoted"' WHEN 'signup' THEN props->>'k' END AS flat
  FROM events)
SELECT event_id, flat,
  CASE event_type WHEN 'view' THEN '["a",null,' || k || ']' WHEN 'error' THEN
    '"it''s \\"quoted\\""' ELSE flat END AS json_text,
  coalesce(flat, '') AS not_null
FROM d
"""


def json_text(spark: SparkSession, sf: str) -> DataFrame:
    """N2 and its repair form on the event properties."""
    keys = jsonl.Keys(plain=(), containers=("details", "features"))
    rows = _event_records(spark, sf, F.concat(F.lit('{"details":'), F.col("props"),
                                              F.lit(',"features":"é"}')), keys)
    r = jsonl.record_of(keys)
    quoted = F.concat(F.lit("{'type': '"), F.col("event_type"), F.lit("'}"))
    return rows.select("event_id", r.json("details").alias("details_json"),
                       r.json("features").alias("features_json"),
                       clean.repair_json_text(quoted).alias("repaired"),
                       clean.repair_json_text(F.col("event_type")).alias("left_alone"))


_JSON_TEXT = """
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS details_json,
  '"é"' AS features_json, '{"type": "' || event_type || '"}' AS repaired,
  event_type AS left_alone
FROM events
"""


def dense_id(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as several files of JSON lines, numbered in file and line order."""
    folder = new_folder(spark, "document-lines")
    (table(spark, sf, "documents").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
     .select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(folder))
    keys = jsonl.Keys(plain=("doc_id", "text"))
    records = jsonl.valid_records(jsonl.parse_lines(
        jsonl.read_lines(spark, folder, "part-*"), keys))
    r = jsonl.record_of(keys)
    rows = records.select(*jsonl.POSITION, clean.to_int(r.text("doc_id")).alias("doc_id"),
                          F.char_length(r.text("text")).alias("n_chars"))
    return dense_ids(rows, "row_id")


_DENSE_ID = """
SELECT doc_id, length(text)::INTEGER AS n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS row_id
FROM documents
"""


def project(spark: SparkSession, sf: str) -> DataFrame:
    """Renaming, missing columns, scalar arithmetic, arrays."""
    part = products(spark, sf).withColumnRenamed("product_title", "title")
    picked = pick_columns(part, ["product_id", "title", "rating_number", "price", "color"])
    return picked.select(
        "product_id", "title", clean.blank_to_empty(F.col("color")).alias("color"),
        F.call_function("div", F.col("rating_number"), F.lit(4)).alias("quarter"),
        F.greatest(F.lit(0.0), F.col("price") - 1000).alias("over"),
        F.least(F.col("price"), F.lit(1000.0)).alias("capped"),
        F.col("price").cast("bigint").alias("whole"),
        F.array_join(F.concat(F.array("title"), F.array(F.lit("x"))), "+").alias("listed"))


_PROJECT = f"""
WITH {PRODUCTS}
SELECT product_id, product_title AS title, '' AS color, rating_number // 4 AS quarter,
  greatest(0.0::DOUBLE, price - 1000) AS over, least(price, 1000.0::DOUBLE) AS capped,
  trunc(price)::BIGINT AS whole, product_title || '+x' AS listed
FROM products
"""


# --- round trips ------------------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Line breaks, quotes, commas and outer white space of texts survive CSV."""
    folder = new_folder(spark, "documents-csv")
    padded = F.concat(F.lit("  \t"), "text", F.lit(" \t \n"))
    rows = table(spark, sf, "documents").select("doc_id", padded.alias("text"), "lang", F.lit(None)
                                                .cast("string").alias("note"))
    written = write_csv(rows, folder)
    back = read_csv(spark, folder, _struct(doc_id=_L, text=_S, lang=_S, note=_S))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang",
                       "note", F.lit(written).cast("bigint").alias("written"))


_CSV_ROUNDTRIP = """
SELECT doc_id, md5('  ' || chr(9) || text || ' ' || chr(9) || ' ' || chr(10)) AS text_md5, lang,
  NULL::VARCHAR AS note,
  (SELECT count(*) FROM documents) AS written
FROM documents
"""


def csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Column types found from the data."""
    folder = new_folder(spark, "part-csv")
    write_csv(table(spark, sf, "part"), folder)
    return read_csv_inferred(spark, folder).select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_size", "p_retailprice")


_CSV_INFERRED = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def refresh_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced twice, read back with declared types; rows without key left out."""
    folder = new_folder(spark, "refreshed")
    schema = _struct(product_id=_L, parent_asin=_S, price=_D, brand=_S)
    rows = products(spark, sf)
    write_table(rows, folder, schema)
    keyed = rows.withColumn("parent_asin", F.when(F.col("main_category") != "PROMO",
                                                  F.col("parent_asin")))
    return write_table(keyed.filter(F.col("parent_asin").isNotNull()), folder, schema)


_REFRESH_TABLE = f"""
WITH {PRODUCTS}
SELECT product_id, parent_asin, price, NULL::VARCHAR AS brand FROM products
WHERE main_category <> 'PROMO'
"""


def typing_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Filled cells that the declared type cannot hold."""
    rows = products(spark, sf).select(
        F.col("product_id").cast("string").alias("product_id"),
        F.col("store").alias("price"), F.when(F.col("rating_number") > 9, F.col("rating_number")
                                              .cast("string")).otherwise("n/a")
        .alias("rating_number"))
    return lost_by_typing(rows, _struct(product_id=_L, price=_D, rating_number=_L))


_TYPING_LOSS = f"""
WITH {PRODUCTS}
SELECT 'product_id' AS "column", 0::BIGINT AS lost_values
UNION ALL SELECT 'price', count(*) FROM products
UNION ALL SELECT 'rating_number', count(*) FILTER (rating_number <= 9) FROM products
"""


def json_document(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON lines written and read back as update entries."""
    folder = new_folder(spark, "entries")
    (products(spark, sf).select("product_id", "product_title", F.array(F.struct(
        F.col("store").alias("filter_value"), F.col("rating_number").alias("match_count")))
        .alias("filters")).write.json(folder))
    return read_filter_document(spark, folder, lines=True).select("product_id", "filters")


_JSON_DOCUMENT = f"""
WITH {PRODUCTS}
SELECT product_id::VARCHAR AS product_id, '[{{"filter_value":"' || store || '","match_count":'
  || rating_number || '}}]' AS filters
FROM products
"""

QUERIES = {
    "q_jsonl_products": jsonl_products, "q_jsonl_rejects": jsonl_rejects,
    "q_jsonl_reviews": jsonl_reviews, "q_timestamps": timestamps,
    "q_safe_numbers": safe_numbers, "q_price": price, "q_bool01": bool01,
    "q_alt_keys": alt_keys, "q_description": description, "q_json_text": json_text,
    "q_dense_id": dense_id, "q_project": project, "q_csv_roundtrip": csv_roundtrip,
    "q_csv_inferred": csv_inferred, "q_refresh_table": refresh_table,
    "q_typing_loss": typing_loss, "q_json_document": json_document,
}

SQL = {
    "q_jsonl_products": _JSONL_PRODUCTS, "q_jsonl_rejects": _JSONL_REJECTS,
    "q_jsonl_reviews": _JSONL_REVIEWS, "q_timestamps": _TIMESTAMPS,
    "q_safe_numbers": _SAFE_NUMBERS, "q_price": _PRICE, "q_bool01": _BOOL01,
    "q_alt_keys": _ALT_KEYS, "q_description": _DESCRIPTION, "q_json_text": _JSON_TEXT,
    "q_dense_id": _DENSE_ID, "q_project": _PROJECT, "q_csv_roundtrip": _CSV_ROUNDTRIP,
    "q_csv_inferred": _CSV_INFERRED, "q_refresh_table": _REFRESH_TABLE,
    "q_typing_loss": _TYPING_LOSS, "q_json_document": _JSON_DOCUMENT,
}
