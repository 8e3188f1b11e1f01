"""Ranked lexical search: exact best documents per item over vectors in order of their length.

A document is the vector of its impacts, whole numbers, on the terms that the items use; an item is
the vector of its terms' weights; the score is their product. Vectors are range-partitioned and
sorted by descending Euclidean length, so partitions and batches in them are buckets of like length.
The longest bucket is searched first; the score of the k-th document there is a lower bound for each
item. In all other buckets

* an item whose length times the bucket's greatest length cannot reach the item's bound skips the
  bucket (Cauchy-Schwarz),
* in a bucket that stays, the item's heaviest terms are multiplied out and the rest of both vectors
  is bounded by the lengths left (coordinate bounds),
* what survives is scored again in 64-bit integers, and raises the task's own bound.

Bounds are computed in doubles and widened by a relative 1e-9, so that rounding never drops a document.
Tasks return at most k rows per item; the engine's limit per key thins these again before the
shuffle. Items are a given query set; they are searched in blocks of about ITEMS_A_BLOCK, of which
only terms, document frequencies and bounds pass through the driver.

NULL texts and texts without a term hold nothing and are never found; every row of ``items`` is a
query of its own, every row of ``docs`` a document. Equal scores are ordered by ``doc_id``, NULL last.
Texts may be of any length. No items or no documents give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.llm.common import limit_batches
from shelfmark.session import stage

#: Bytes of terms: digits, letters (lower-cased before) and all of UTF-8 outside ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

ITEMS_A_BLOCK = 2000

#: Terms of an item that are multiplied out before its bound is taken.
FOCUS = 6

_SLACK = 1 + 1e-9
_NO_ID = np.iinfo(np.int64).max  # stands for NULL inside tasks, behind all others

Weights = tuple[np.ndarray, np.ndarray]  # term numbers and weights of an item, heaviest first


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text; only A-Z are lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


def count_terms(docs: DataFrame, numbers: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """``doc_id``, ``n`` (all terms) and, for the terms numbered, ``terms`` and ``tfs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.keys()
        for batch in batches:
            sizes, ids, counts, ends = [], [], [], [0]
            for t in batch.column("t"):
                words = terms_of(t.as_py())
                found = Counter(words)
                for w in found.keys() & known:
                    ids.append(numbers[w])
                    counts.append(found[w])
                sizes.append(len(words))
                ends.append(len(ids))
            cut = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(counts, pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def impacts(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, terms, impacts, length`` of documents that hold one of the numbered terms."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    wide = whole(F.lit(50), 2) * whole(F.col("n"), 17) * whole(F.lit(n_docs), 17)  # over 64 bits
    rows = (counted.filter(F.size("terms") > 0).withColumn("wide", wide)
            .withColumn("all_terms", whole(F.lit(max(n_terms, 1)), 19))
            .withColumn("m", F.expr("CAST(100 - 50 + wide div all_terms AS BIGINT)")))
    rows = rows.withColumn("impacts", F.expr(
        "transform(tfs, tf -> (1000000000 * tf) div (1000 * tf + 20 * m))"))
    return rows.select("doc_id", "terms", "impacts", F.sqrt(F.aggregate(
        "impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("length"))


class Block:
    """Vectors of one batch, in order of descending length, with postings per term."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("terms")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.impacts = batch.column("impacts").flatten().to_numpy(zero_copy_only=False)[order]
        terms = terms[order]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else []
        ends = np.r_[starts[1:], len(terms)] if len(terms) else []
        self.spans = {int(terms[a]): (int(a), int(b)) for a, b in zip(starts, ends)}
        self.lengths = batch.column("length").to_numpy(zero_copy_only=False)
        self.longest = float(self.lengths.max()) if len(sizes) else 0.0
        self.ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()

    def survivors(self, item: Weights, bound: int) -> np.ndarray | None:
        """Rows that may reach ``bound``; None if the lengths alone rule all of them out."""
        terms, weights = item
        if math.sqrt(float((weights.astype(float) ** 2).sum())) * self.longest * _SLACK < bound:
            return None
        if bound <= 0:
            return np.ones(len(self.lengths), bool)
        product, squares = np.zeros(len(self.lengths)), self.lengths ** 2
        for term, weight in zip(terms[:FOCUS].tolist(), weights[:FOCUS].tolist()):
            a, b = self.spans.get(term, (0, 0))
            part = self.impacts[a:b].astype(float)
            product[self.rows[a:b]] += weight * part
            squares[self.rows[a:b]] -= part * part
        rest = math.sqrt(float((weights[FOCUS:].astype(float) ** 2).sum()))
        left = np.sqrt(np.maximum(squares, 0) + self.lengths ** 2 * 1e-9)
        return (product + rest * left) * _SLACK >= bound

    def scores(self, item: Weights) -> np.ndarray:
        """Exact scores of all rows."""
        total = np.zeros(len(self.lengths), np.int64)
        for term, weight in zip(*(x.tolist() for x in item)):
            a, b = self.spans.get(term, (0, 0))
            if b > a:
                total[self.rows[a:b]] += weight * self.impacts[a:b]
        return total


def best_in_task(vectors: DataFrame, items: list[Weights], bounds: list[int], k: int) -> DataFrame:
    """At most ``k`` rows ``item, doc_id, score`` per item and task, the best ones of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = list(bounds)
        empty = np.zeros(0, np.int64)
        best = [(empty, empty) for _ in items]
        for batch in batches:
            block = Block(batch)
            for i, item in enumerate(items):
                alive = block.survivors(item, floor[i])
                if alive is None or not alive.any():
                    continue
                score = block.scores(item)
                hit = np.flatnonzero(alive & (score >= max(floor[i], 1)))
                if not len(hit):
                    continue
                s, d = np.r_[best[i][0], score[hit]], np.r_[best[i][1], block.ids[hit]]
                top = np.lexsort((d, -s))[:k]
                best[i] = s[top], d[top]
                if len(top) == k:
                    floor[i] = max(floor[i], int(s[top[-1]]))
        number = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in best])
        score = np.concatenate([empty, *(s for s, _ in best)])
        ids = np.concatenate([empty, *(d for _, d in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(ids, mask=ids == _NO_ID), pa.array(score)],
            ["item", "doc_id", "score"])

    return vectors.select("doc_id", "terms", "impacts", "length").mapInArrow(
        run, "item int, doc_id bigint, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str | None], k: int, text: str, doc_id: str) -> DataFrame:
    wanted = [sorted(set(terms_of(t))) for t in texts]
    numbers = {w: i for i, w in enumerate(sorted({w for ws in wanted for w in ws}))}
    counted = stage(count_terms(docs, numbers, text, doc_id), "lexical-counts")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = {r.term: r.df for r in counted.select(F.explode("terms").alias("term"))
               .groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator()}
    weight = {t: math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df + 1)))
              for t, df in holding.items()}
    items = []
    for ws in wanted:
        pairs = sorted(((weight[numbers[w]], numbers[w]) for w in ws if numbers[w] in weight),
                       reverse=True)
        items.append((np.array([t for _, t in pairs], np.int64),
                      np.array([w for w, _ in pairs], np.int64)))
    vectors = impacts(counted, total.docs, total.terms)
    tie = F.xxhash64("doc_id", "terms", "impacts", F.monotonically_increasing_id())
    ordered = (vectors.withColumn("tie", tie).repartitionByRange(F.col("length").desc(), "tie")
               .sortWithinPartitions(F.col("length").desc())
               .withColumn("bucket", F.spark_partition_id()).drop("tie"))
    buckets = stage(ordered, "lexical-vectors")
    first = stage(_top(best_in_task(buckets.filter(F.col("bucket") == 0), items,
                                    [0] * len(items), k), k), "lexical-first")
    bounds = [0] * len(items)
    for r in first.filter(F.col("rank") == k).select("item", "score").collect():
        bounds[r["item"]] = r["score"]
    rest = best_in_task(buckets.filter(F.col("bucket") > 0), items, bounds, k)
    return _top(first.drop("rank").unionByName(rest), k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text",
           doc_id: str = "doc_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each row of ``items``: the item's columns (but its text) with
    ``rank``, ``doc_id`` and ``score``; item columns of these names are replaced."""
    spark: SparkSession = docs.sparkSession
    new = ["rank", "doc_id", "score"]
    kept = [c for c in items.columns if c != item_text and c not in new]
    rows = stage(items.select(F.struct(*kept).alias("row") if kept else F.lit(0).alias("row"),
                              F.col(item_text).alias("item_text"),
                              F.monotonically_increasing_id().alias("number")), "lexical-items")
    blocks = max(1, -(-rows.count() // ITEMS_A_BLOCK))
    out = None
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).orderBy("number")
        listed = block.select("number", "item_text").collect()
        found = _search_block(docs, [r.item_text for r in listed], k, text, doc_id)
        of = spark.createDataFrame([(i, r.number) for i, r in enumerate(listed)],
                                   "item int, number bigint")
        found = found.join(of, "item").join(block.select("number", "row"), "number")
        found = found.select(*(F.col("row")[c].alias(c) for c in kept), "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
