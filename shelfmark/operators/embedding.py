"""Product documents, token windows and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.constants import (BATCH_SIZE, MIN_DOCUMENT_CHARS, POOL_EPSILON, REVIEWS_PER_PRODUCT,
                                 SPECIAL_TOKENS, WINDOW_OVERLAP, WINDOW_TOKENS)
from shelfmark.functions.clean import blank_to_empty, is_empty
from shelfmark.functions.text import strip, tokens
from shelfmark.functions.vector import l2_normalize, to_float32, zero_if_missing

VECTOR_SIZE = 64

#: Parts that the reviews of a product are ranked in first, where ``k`` is above the engine's limit.
PARTS = 64


def top_reviews(reviews: DataFrame, k: int = REVIEWS_PER_PRODUCT, key: str = "parent_asin",
                votes: str = "helpful_vote", ties: list[Column] | None = None) -> DataFrame:
    """The ``k`` most helpful reviews per product with their ``rank``; missing votes last.

    A product with a third of all reviews is never ranked in one task. Up to the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` the engine keeps ``k`` rows per key and task
    before the shuffle. Above it a first level ranks ``PARTS`` parts of each product apart, and the
    second one sees at most ``PARTS * k`` rows of it.
    """
    ties = ties if ties is not None else [F.col("review_ts").desc_nulls_last(), F.col("user_id"),
                                          F.col("review_title"), F.col("review_text")]
    keyed = reviews.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    order = [F.col(votes).desc_nulls_last(), *ties]
    limit = int(reviews.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
        parted = W.partitionBy(key, "__part").orderBy(*order)
        keyed = (keyed.withColumn("__part", part)
                 .withColumn("__rank", F.row_number().over(parted)).filter(F.col("__rank") <= k)
                 .drop("__part", "__rank"))
    return (keyed.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
            .filter(F.col("rank") <= k))


def review_parts(ranked: DataFrame, key: str = "parent_asin", title: str = "review_title",
                 text: str = "review_text") -> DataFrame:
    """Per product the titles and texts of its ranked reviews, alternating, as one array."""
    entry = F.struct("rank", blank_to_empty(F.col(title)).alias("title"),
                     blank_to_empty(F.col(text)).alias("text"))
    return (ranked.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
            .select(key, F.flatten(F.transform("ranked", lambda r: F.array(
                r["title"], r["text"]))).alias("parts")))


def product_documents(products: DataFrame, reviews: DataFrame, k: int = REVIEWS_PER_PRODUCT,
                      min_chars: int = MIN_DOCUMENT_CHARS, skip_empty_json: bool = False,
                      **ranking) -> DataFrame:
    """``(product_id, parent_asin, document)``.

    Title, features, details and the top reviews, stripped, without blanks, one per line. Products
    without a key get no reviews; documents under ``min_chars`` characters are dropped.
    """
    parts = review_parts(top_reviews(reviews, k, **ranking))
    base = products.select("product_id", blank_to_empty(F.col("parent_asin")).alias("parent_asin"),
                           "product_title", "features_json", "details_json")
    joined = base.join(parts, "parent_asin", "left")
    json_part = lambda c: F.when(~is_empty(F.col(c)), F.col(c)) if skip_empty_json else F.col(c)
    pieces = F.concat(F.array(F.col("product_title"), json_part("features_json"),
                              json_part("details_json")),
                      F.coalesce("parts", F.array().cast("array<string>")))
    stripped = F.filter(F.transform(pieces, strip), lambda p: p != "")
    return (joined.select("product_id", "parent_asin",
                          F.array_join(stripped, "\n").alias("document"))
            .filter(F.char_length("document") >= min_chars))


def windows(token_array: Column, max_length: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP,
            special: int = SPECIAL_TOKENS) -> Column:
    """Overlapping token windows. Each holds ``max_length - special`` tokens at most, and
    neighbours share ``overlap`` tokens. The last window ends with the text."""
    width = max_length - special
    step = width - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than a window")
    size = F.size(token_array)
    last = F.ceil(F.greatest(size - width, F.lit(0)) / step).cast("int") * step
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)),
                       lambda start: F.slice(token_array, start + 1, F.lit(width)))


def token_windows(documents: DataFrame, keys: list[str], text: str = "document",
                  tokenize: Callable[[Column], Column] = tokens, **shape) -> DataFrame:
    """One row per window: ``(keys..., window, tokens)``; a text without tokens has one empty row."""
    toks = tokenize(F.col(text))
    return documents.select(*keys, toks.alias("all_tokens")).select(
        *keys, F.posexplode(windows(F.col("all_tokens"), **shape)).alias("window", "tokens"))


def hashed_codes(token_array: Column, dim: int = VECTOR_SIZE) -> Column:
    """Token codes of the default encoder: a signed dimension number per token, from md5.

    The first eight hex digits choose the dimension, the ninth the sign. Code ``d + 1`` stands for
    +1 in dimension ``d``, ``-(d + 1)`` for -1.
    """
    def code(token: Column) -> Column:
        digest = F.md5(token.cast("binary"))
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim + 1
        negative = F.substring(digest, 9, 1) >= "8"
        return F.when(negative, -place).otherwise(place).cast("int")
    return F.transform(token_array, code)


def hashed_encoder(dim: int = VECTOR_SIZE) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Default batch encoder: mean of the signed unit vectors of a window's token codes."""
    def encode(batch: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(codes) for codes in batch])
        flat = np.concatenate(batch) if len(batch) else np.zeros(0, dtype=np.int64)
        rows = np.repeat(np.arange(len(batch)), lengths)
        sums = np.zeros((len(batch), dim))
        np.add.at(sums, (rows, np.abs(flat) - 1), np.sign(flat))
        return sums / np.maximum(lengths, POOL_EPSILON)[:, None]
    return encode


def encode_windows(window_rows: DataFrame, keys: list[str],
                   make_encoder: Callable[[], Callable[[list], np.ndarray]],
                   column: str = "codes", batch_size: int = BATCH_SIZE) -> DataFrame:
    """``(keys..., window, vector)``. The encoder is built once per task and fed batches.

    ``make_encoder`` returns a function from a list of token arrays to a matrix; a neural model
    plugs in here and loads its weights inside the call.
    """
    types = {f.name: f.dataType.simpleString() for f in window_rows.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["window int", "vector array<double>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                vectors = encode([np.asarray(c, dtype=np.int64) for c in part[column]])
                yield part[[*keys, "window"]].assign(vector=list(vectors))

    return window_rows.select(*keys, "window", column).mapInPandas(run, schema)


def mean_vectors(vectors: DataFrame, keys: list[str], column: str = "vector") -> DataFrame:
    """E5, A10: element-wise mean per key. Partial sums are dense arrays, so a key with very many
    vectors sends one array per task."""
    mean = Summarizer.mean(array_to_vector(F.col(column).cast("array<double>")))
    return vectors.groupBy(*keys).agg(vector_to_array(mean).alias(column))


def masked_mean(rows: DataFrame, keys: list[str], vector: str, mask: str) -> DataFrame:
    """Mean over token vectors with a 0/1 mask, the divisor at least POOL_EPSILON."""
    weighted = rows.select(*keys, F.col(mask).cast("double").alias("mask"),
                           F.posexplode(vector).alias("pos", "x"))
    pooled = weighted.groupBy(*keys, "pos").agg(
        (F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(POOL_EPSILON)))
        .alias("x"))
    return pooled.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector))


def product_vectors(documents: DataFrame, make_encoder=None, dim: int = VECTOR_SIZE,
                    batch_size: int = BATCH_SIZE, keys: list[str] = ("product_id", "parent_asin"),
                    **shape) -> DataFrame:
    """One float32 unit vector per document, the mean of its window vectors."""
    keys = list(keys)
    cut = token_windows(documents, keys, **shape)
    coded = cut.withColumn("codes", hashed_codes(F.col("tokens"), dim))
    encoded = encode_windows(coded, keys, make_encoder or (lambda: hashed_encoder(dim)),
                             batch_size=batch_size)
    mean = mean_vectors(encoded, keys)
    return mean.select(*keys, to_float32(l2_normalize(
        zero_if_missing(F.col("vector"), dim))).alias("vector"))


def not_yet_done(products: DataFrame, done: DataFrame | None, key: str = "product_id") -> DataFrame:
    """Products without a vector in the output, for a restart."""
    return products if done is None else products.join(done.select(key), key, "left_anti")
