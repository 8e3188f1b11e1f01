"""A stored inverted index (T2, W8) that phrase runs read again and again.

Postings of a token are cut into blocks of ROW_SPAN row ids, so no list grows with the table however
common its token is. A block is delta-coded: steps from row to row, and from place to place inside a
row. Texts are moved to the task of their rows' block before they are cut into postings, so blocks are
built where the postings arise, and what is moved after that is coded. ``blocks`` is bucketed by
(field, token, block), so a lookup joins it without moving it; ``skips`` has one small row per block
(which rows, how many postings), from which lookups choose their blocks.

Row ids are whole numbers, as the numbering of the product table gives them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions.text import padded_tokens
from shelfmark.operators.phrases import FIELD, phrase_key
from shelfmark.session import stage

ROW_SPAN = 4096
KEY = [FIELD, "token", "block"]
_BLOCK = ("field string, token string, block bigint, first_row bigint, last_row bigint, "
          "documents bigint, rows array<int>, places array<int>")
_PLACE = "field string, token string, row_id bigint, pos int"


@dataclass(frozen=True)
class StoredIndex:
    blocks: str    # table name
    skips: str     # table name
    spark: SparkSession

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)


def block_of(row_id: Column) -> Column:
    return F.floor(row_id / F.lit(ROW_SPAN)).cast("bigint")


def _coded(texts: pa.Table) -> pa.Table:
    """Coded postings of the texts of one field and block, which are ROW_SPAN rows at most."""
    texts = texts.combine_chunks()
    body = texts["body"].cast(pa.large_string()).combine_chunks()
    lists = pc.split_pattern(pc.utf8_trim(body, " "), " ")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    token = words.indices.to_numpy()
    row = np.repeat(texts["row_id"].to_numpy(), sizes)
    place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((place, row, token))
    token, row, place = token[order], row[order], place[order]
    head = np.r_[True, token[1:] != token[:-1]]
    new_row = head | np.r_[True, row[1:] != row[:-1]]
    # steps from the posting before; the first of a token follows its own row at place 0
    row_step = np.where(head, 0, np.diff(row, prepend=row[:1]))
    place_step = np.where(new_row, place, np.diff(place, prepend=0))
    at = np.flatnonzero(head)
    ends = np.r_[at, len(token)]
    cut = lambda steps: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, pa.int32()))
    same = pa.array(np.zeros(len(at), np.int32))
    return pa.table([
        texts[FIELD].combine_chunks().take(same), words.dictionary.take(pa.array(token[at])).cast(pa.string()),
        texts["block"].combine_chunks().take(same), pa.array(row[at]), pa.array(row[ends[1:] - 1]),
        pa.array(np.add.reduceat(new_row.astype(np.int64), at)), cut(row_step), cut(place_step)],
        [*KEY, "first_row", "last_row", "documents", "rows", "places"])


def encode_blocks(bodies: DataFrame) -> DataFrame:
    """``(field, token, block, first_row, last_row, documents, rows, places)`` of the postings of
    ``bodies``; the texts are shuffled, the postings are not."""
    texts = bodies.select(FIELD, block_of(F.col("row_id")).alias("block"),
                          F.col("row_id").cast("bigint").alias("row_id"), "body")
    return texts.groupBy(FIELD, "block").applyInArrow(_coded, _BLOCK)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """Postings ``(field, token, row_id, pos)`` of encoded blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            step = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            total = np.cumsum(step)
            begin = total[first] - step[first] if len(step) else total
            row = batch.column("first_row").to_numpy()[owner] + total - begin[owner]
            place = np.cumsum(batch.column("places").flatten().to_numpy(zero_copy_only=False)
                              .astype(np.int64))
            # places start anew with every row: take off what was summed up before it
            new = np.zeros(len(step), bool)
            new[first] = True
            new |= step > 0
            starts = np.flatnonzero(new)
            base = np.r_[0, place[starts[1:] - 1]] if len(starts) else place
            place = place - np.repeat(base, np.diff(np.r_[starts, len(step)]))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(FIELD).take(take), batch.column("token").take(take),
                 pa.array(row), pa.array(place.astype(np.int32))], ["field", "token", "row_id", "pos"])

    return blocks.select(FIELD, "token", "first_row", "rows", "places").mapInArrow(run, _PLACE)


def block_stats(blocks: DataFrame) -> DataFrame:
    """Documents and occurrences per token of encoded blocks. A row lies in one block of a token, so
    blocks add up, and only one row per token and task is moved."""
    return blocks.groupBy(FIELD, "token").agg(F.sum("documents").alias("documents"),
                                              F.sum(F.size("rows").cast("bigint")).alias("occurrences"))


def store_index(bodies: DataFrame, folder: str, buckets: int | None = None) -> StoredIndex:
    """Write the index of ``bodies`` below ``folder`` as two tables of the session's catalogue."""
    spark = bodies.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex
    names = StoredIndex(f"index_blocks_{mark}", f"index_skips_{mark}", spark)
    encoded = encode_blocks(bodies).repartition(buckets, *KEY)
    (encoded.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{folder}/blocks")
     .saveAsTable(names.blocks))
    (spark.table(names.blocks).select(*KEY, "first_row", "last_row", "documents",
                                      F.size("rows").alias("postings"))
     .write.option("path", f"{folder}/skips").saveAsTable(names.skips))
    return names


def blocks_at(index: StoredIndex, keys: DataFrame) -> DataFrame:
    """The blocks of distinct ``(field, token, block)``; only ``keys`` are moved."""
    return index.table(index.blocks).join(keys, KEY)


def lookup(index: StoredIndex, phrases: DataFrame) -> DataFrame:
    """``(field, phrase_id, row_id)`` of distinct padded phrases ``(field, phrase)``.

    The rarest token of a phrase names the places to try; the blocks of the other tokens are read
    only where such a place needs them.
    """
    listed = stage(phrases.select(FIELD, phrase_key(F.col("phrase")).alias("phrase_id"),
                                  F.posexplode(padded_tokens(F.col("phrase"))).alias("i", "token"))
                   .distinct(), "phrase-tokens")
    skips = index.table(index.skips)
    known = skips.join(listed.select(FIELD, "token").distinct(), [FIELD, "token"], "left_semi")
    known = stage(known.select(*KEY, "documents"), "known-blocks")
    rare = known.groupBy(FIELD, "token").agg(F.sum("documents").alias("documents"))
    sizes = listed.groupBy(FIELD, "phrase_id").agg(F.count(F.lit(1)).alias("n"))
    anchors = (listed.join(rare, [FIELD, "token"]).groupBy(FIELD, "phrase_id")
               .agg(F.min(F.struct("documents", "i", "token")).alias("a"),
                    F.count(F.lit(1)).alias("found"))
               .join(sizes, [FIELD, "phrase_id"]).filter(F.col("found") == F.col("n"))
               .select(FIELD, "phrase_id", "n", F.col("a.token").alias("token"), F.col("a.i").alias("at")))
    anchors = stage(anchors, "phrase-anchors")
    keys = known.join(anchors.select(FIELD, "token").distinct(), [FIELD, "token"], "left_semi")
    tried = decode_blocks(blocks_at(index, keys.select(*KEY))).join(anchors, [FIELD, "token"]).select(
        FIELD, "phrase_id", "n", "row_id", (F.col("pos") - F.col("at")).alias("start"), "at")
    tried = stage(tried.filter(F.col("start") >= 0), "phrase-places")
    needed = (tried.join(listed, [FIELD, "phrase_id"]).filter(F.col("i") != F.col("at"))
              .select(FIELD, "phrase_id", "n", "row_id", "start", "token",
                      (F.col("start") + F.col("i")).alias("pos")))
    asked = needed.select(FIELD, "token", block_of(F.col("row_id")).alias("block")).distinct()
    asked = asked.join(known.select(*KEY), KEY, "left_semi")
    held = needed.join(decode_blocks(blocks_at(index, asked)), [FIELD, "token", "row_id", "pos"],
                       "left_semi")
    whole = (held.groupBy(FIELD, "phrase_id", "n", "row_id", "start").agg(F.count(F.lit(1)).alias("k"))
             .filter(F.col("k") == F.col("n") - 1).select(FIELD, "phrase_id", "row_id"))
    single = tried.filter(F.col("n") == 1).select(FIELD, "phrase_id", "row_id")
    return whole.unionByName(single).distinct()
