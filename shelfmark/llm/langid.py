"""Language identification by compression with one zstandard dictionary per language.

A language's dictionary is the raw text of a bounded sample of its labelled rows, one piece of each
from a place that its hash chooses. A text is encoded
in blocks with every dictionary; the language whose blocks are smallest in total wins, and a narrow
margin marks the row as rejected. Whole texts are encoded, lower-cased and block by block, so that a
long text is judged by the dictionaries all the way and not by its own beginning.

Defined results: NULL text and text without any letter get ``und``, score 0 and are rejected; ties
go to the language with most labelled rows; with no labelled row at all every text is ``und``;
repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import limit_batches

SAMPLE_ROWS = 400     # distinct texts per language in the dictionary: the bound of the sample
SAMPLE_CHARS = 500    # of each; a dictionary holds at most SAMPLE_ROWS * SAMPLE_CHARS characters
LEVEL = 3
BLOCK_BYTES = 4096
MIN_MARGIN = 0.01     # relative gap between best and second best below which a row is rejected
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"[\W\d_]+")


def train(docs: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS,
          chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries from the rows of ``docs`` (text, lang) that ``learn_from`` accepts, most
    frequent language first.

    The sample is the ``rows`` texts of lowest hash per language. Hashes alone decide on it, so
    only they are ranked (a rank limit per task comes before the shuffle); texts of the sample are
    then read in a second pass. At most languages * rows pieces reach the driver.
    """
    usable = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h"))
    lowest = Window.partitionBy("lang").orderBy("h")
    texts = usable.select("lang", "h").distinct()
    limits = (texts.withColumn("rank", F.row_number().over(lowest)).filter(F.col("rank") <= rows)
              .groupBy("lang").agg(F.max("h").alias("limit")).collect())
    if not limits:
        return {}
    chosen = F.lit(False)
    for r in limits:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.col("h") <= r["limit"]))
    common = [r["lang"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "lang").collect()]
    # the hash decides where in the whole text a piece lies, so that a common header is no more
    # likely to be learned than the body
    room = F.greatest(F.length("text") - chars, F.lit(0))
    piece = F.substring("text", F.pmod("h", room + 1).cast("int") + 1, F.lit(chars))
    pieces = (usable.filter(chosen).groupBy("lang", "h")
              .agg(F.min(piece).alias("piece")).collect())
    out: dict[str, list[tuple[int, str]]] = {}
    for r in pieces:
        out.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    return {lang: " ".join(_plain(p) for _, p in sorted(out[lang])).encode("utf-8", "replace")
            for lang in common}


def _plain(text: str) -> str:
    """Lower case, letters only, single blanks: what the encoder compares."""
    return _GAPS.sub(" ", text.lower())


def identify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (0 to 1), margin, rejected."""
    spark = docs.sparkSession
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # languages * SAMPLE_ROWS * SAMPLE_CHARS at most

    @F.pandas_udf("struct<lang_pred string, score double, margin double, rejected boolean>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = list(shared.value)
        encoders = []
        for name in names:
            data = zstd.ZstdCompressionDict(shared.value[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            encoders.append(zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False,
                                                write_content_size=False, write_dict_id=False))
        for texts in batches:
            yield pd.DataFrame([_judge(t, names, encoders, min_margin) for t in texts],
                               columns=["lang_pred", "score", "margin", "rejected"])

    found = docs.withColumn("found", classify("text"))
    return found.select(*[F.col(c) for c in docs.columns if c not in
                          ("lang_pred", "score", "margin", "rejected")], "found.*")


def _judge(text, names, encoders, min_margin):
    if not names or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0, True
    data = _plain(text).encode("utf-8", "replace")
    blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = [sum(len(e.compress(b)) for b in blocks) for e in encoders]
    order = sorted(range(len(names)), key=sizes.__getitem__)
    best = sizes[order[0]]
    second = sizes[order[1]] if len(order) > 1 else 2 * best
    margin = (second - best) / second
    return names[order[0]], 0.5 + 0.5 * min(1.0, margin / (10 * MIN_MARGIN)), margin, \
        margin < min_margin
