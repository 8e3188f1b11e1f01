"""The training-text pipeline: filter, deduplicate, decontaminate and tokenize ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last one adds the token ids. ``run`` writes every stage's result as
Parquet to the shared folder and reads it back as the next one's input, so a lost executor repeats
one stage at most. There is no SQL for the whole, because the first stage is a trained classifier.
The operators beneath are tested against brute force; of the stages as such the line, near-duplicate
and benchmark ones have tests, on planted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import bpe, decontaminate, hyperminhash, linedup, toxicity
from shelfmark.llm.catalog import tokenizer
from shelfmark.llm.common import id_remainder, table
from shelfmark.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the rows that op9 learns from."""
    learn = F.coalesce(id_remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, model).filter(F.col("predicted") == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words and more leave the texts; a document that only repeats
    others goes, one without any text to begin with stays."""
    found = linedup.remove_repeated_lines(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return (found.filter(~F.col("emptied")).withColumn("n_chars", length.cast("bigint"))
            .select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest id, rows without an id last. Five-word
    shingles, 0.8. Of rows with equal id and text one stays; texts without words link with nothing
    and stay, unless their id is on another such row."""
    found = stage(hyperminhash.grouped_rows(docs, width=5, percent=80), "near")
    gone = found.filter(~F.col("kept")).select("row").distinct()
    twice = (found.filter(F.col("kept") & (F.col("doc_id").isNotNull() | (F.col("n_shingles") > 0)))
             .groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("row"))
    rows = docs.withColumn("row", hyperminhash.row_key(docs))
    single = rows.join(gone.union(twice), "row", "left_anti").select(*docs.columns)
    whole = F.struct(*docs.columns)
    again = (rows.join(twice, "row", "left_semi").groupBy("row").agg(F.min(whole).alias("r"))
             .select("r.*"))
    return single.union(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id"))
                     & (F.xxhash64("text") == F.col("gone")), "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, their token ids and the number of these."""
    return bpe.encode(docs, tokenizer()).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
