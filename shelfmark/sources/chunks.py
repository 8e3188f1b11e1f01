"""One file read by many tasks, where a record's end depends on all that stands before it.

A file is read in pieces that end with a separator, as the engine splits text. What a piece does is a
function of one bit (are we inside quotes?): the bit behind it, and how far it goes up or down the
brackets. Such functions compose, so

1. every task composes the functions of its splits, for both values of the bit,
2. one pass over the splits of a file (one row per split) gives bit and depth at every split's start,
3. every task cuts its splits into records; only the ends of splits, where a record goes on in the
   next one, are shuffled and put together.

The file is read twice and no text before a split is needed to parse it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.session import stage

#: Bit behind a piece for bit 0 and 1 before it, and its change of depth for both.
Step = tuple[int, int, int, int]


@dataclass(frozen=True)
class Form:
    """How a text format is cut: pieces end with ``separator``, records where the bit is 0 and the
    depth is ``level``."""

    separator: str
    level: int
    step: Callable[[str], Step]


def pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """``(file, block, value)``; rows of a split come in order."""
    return spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in batch.schema.names))


_SPLIT = ("file string, block bigint, end0 int, end1 int, depth0 bigint, depth1 bigint, "
          "first string, last string")


def _compose(form: Form):
    """Per split the function of all its pieces, and its first and last characters but blanks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out, at = form.step, [], None
        for batch in batches:
            for (file, block), rows in groupby(_rows(batch), lambda r: r[:2]):
                if at is None or at[:2] != [file, block]:
                    if at is not None:
                        out.append(at)
                    at = [file, block, 0, 1, 0, 0, None, None]
                _, _, bit0, bit1, depth0, depth1, first, last = at
                for _, _, value in rows:
                    end0, end1, up0, up1 = step(value)
                    depth0 += up1 if bit0 else up0
                    depth1 += up1 if bit1 else up0
                    bit0 = end1 if bit0 else end0
                    bit1 = end1 if bit1 else end0
                    bare = value.strip().strip("﻿")
                    if bare:
                        first, last = first or bare[0], bare[-1]
                at[2:] = [bit0, bit1, depth0, depth1, first, last]
        if at is not None:
            out.append(at)
        names = [f.split()[0] for f in _SPLIT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(),
                 pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
    return run


_START = "file string, block bigint, bit int, depth bigint, first string, end_bit int, " \
         "end_depth bigint, end_last string"


def _prefix(splits: pd.DataFrame) -> pd.DataFrame:
    """Bit and depth at the start of every split of one file, and behind its last one."""
    splits, bit, depth = splits.sort_values("block"), 0, 0
    starts = []
    for r in splits.itertuples():
        starts.append((r.file, r.block, bit, depth))
        depth += r.depth1 if bit else r.depth0
        bit = r.end1 if bit else r.end0
    out = pd.DataFrame(starts, columns=["file", "block", "bit", "depth"])
    seen, ended = splits["first"].dropna(), splits["last"].dropna()
    return out.assign(first=seen.iloc[0] if len(seen) else None, end_bit=bit, end_depth=depth,
                      end_last=ended.iloc[-1] if len(ended) else None)


def split_starts(found: DataFrame, form: Form) -> DataFrame:
    """``(file, block, bit, depth)`` at the start of every split, and per file ``first`` and
    ``end_last``, its outer characters, and ``end_bit`` and ``end_depth``. One row per split."""
    composed = found.mapInArrow(_compose(form), _SPLIT)
    return stage(composed.groupBy("file").applyInPandas(_prefix, _START), "splits")


_RECORD = "file string, block bigint, row bigint, part string, text string"


def _cut(form: Form):
    """Records of every split. ``part`` tells whole ones from those that began before the split
    (``head``), go on behind it (``tail``) or both (``middle``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, level, separator = form.step, form.level, form.separator
        key, bit, depth, row, began, held = None, 0, 0, 0, True, []

        def rest():
            return (*key, row, "tail" if began else "middle",
                    "".join(value + separator for value in held))
        for batch in batches:
            out = []
            for file, block, bit0, depth0, value in _rows(batch):
                if key != (file, block):
                    if held:
                        out.append(rest())
                    key, bit, depth, row, held = (file, block), bit0, depth0, 0, []
                    began = block == 0 or (bit == 0 and depth == level)
                end0, end1, up0, up1 = step(value)
                depth += up1 if bit else up0
                bit = end1 if bit else end0
                held.append(value)
                if bit == 0 and depth == level:
                    out.append((*key, row, "whole" if began else "head", separator.join(held)))
                    row, held, began = row + 1, [], True
            if out:
                yield _records(out)
        if held:
            yield _records([rest()])
    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def records(found: DataFrame, starts: DataFrame, form: Form) -> DataFrame:
    """``(file, position, text, closed)``: the records without their last separator, and what is
    left behind the last one of a file (``closed`` is false).

    ``starts`` is broadcast: it has one row per split, and the driver lists these anyway. A split
    that the first pass did not see (the engine may split anew when executors come and go) ends the
    query with an error instead of losing rows.
    """
    known = F.broadcast(starts.select("file", "block", "bit", "depth"))
    unseen = F.raise_error(F.lit("the file was split anew between both passes: run again, or set "
                                 "spark.sql.files.minPartitionNum")).cast("int")
    placed = found.join(known, ["file", "block"], "left").select(
        "file", "block", F.coalesce("bit", unseen).alias("bit"), "depth", "value")
    cut = stage(placed.mapInArrow(_cut(form), _RECORD), "records")
    place = F.struct("block", "row").alias("position")
    whole = cut.filter(F.col("part") == "whole").select("file", place, "text",
                                                        F.lit(True).alias("closed"))
    ends = cut.filter(F.col("part") != "whole")
    before = (Window.partitionBy("file").orderBy("block", F.col("part") != "head")
              .rowsBetween(Window.unboundedPreceding, -1))
    heads = F.coalesce(F.sum((F.col("part") == "head").cast("int")).over(before), F.lit(0))
    together = (ends.withColumn("record", heads).groupBy("file", "record")
                .agg(F.sort_array(F.collect_list(F.struct("block", "row", "part", "text"))).alias("p")))
    joined = together.select(
        "file", F.struct(F.col("p")[0]["block"].alias("block"), F.col("p")[0]["row"].alias("row"))
        .alias("position"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"),
        (F.element_at("p", -1)["part"] == "head").alias("closed"))
    return whole.unionByName(joined)


_ESCAPE = re.compile(r"\\.", re.DOTALL)


def json_step(piece: str) -> Step:
    """What a piece of JSON does that ends with a closing brace. No escape reaches over that end:
    a backslash before a brace is no JSON."""
    if "\\" in piece:
        piece = _ESCAPE.sub("", piece)
    parts = piece.split('"')
    end = (len(parts) - 1) & 1
    ups = []
    for bare, closed in (("".join(parts[::2]), end == 0), ("".join(parts[1::2]), end == 1)):
        ups.append(bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]") - closed)
    return end, 1 - end, ups[0], ups[1]


_CLOSED = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


def csv_step(separator: str) -> Callable[[str], Step]:
    """What a line of CSV does: inside quotes or not behind it. A quote counts only where a cell
    begins; a doubled one stands for itself."""
    opening = separator + '"'

    def outside(line: str, at: int) -> int:
        """Bit behind the line, from a place outside quotes that is not the start of a cell."""
        while (at := line.find(opening, at)) >= 0:
            found = _CLOSED.match(line, at + len(opening))
            if found is None:
                return 1
            at = found.end()
        return 0

    def inside(line: str, at: int) -> int:
        found = _CLOSED.match(line, at)
        return 1 if found is None else outside(line, found.end())

    def step(line: str) -> Step:
        if '"' not in line:
            return 0, 1, 0, 0
        return inside(line, 1) if line[0] == '"' else outside(line, 0), inside(line, 0), 0, 0
    return step


#: Elements of one JSON array.
JSON_ARRAY = Form("}", 1, json_step)


def csv_lines(separator: str = ",") -> Form:
    """Rows of CSV."""
    return Form("\n", 0, csv_step(separator))
