"""Fill-in-the-middle by piece tables.

A document is never cut up or copied while it is rearranged. It is a list of descriptors
``(buffer, start, length)`` in bytes over two immutable buffers, its text in UTF-8 and the sentinels.
Cutting splits the descriptor, an arrangement permutes the list, the inverse permutation brings
the document's order back, and a digest is taken by streaming the descriptors' bytes. Only finding
the cuts and the digests run in Python, one Arrow batch at a time; descriptors are plain columns.

NULL text counts as empty. A text that is empty or already holds a sentinel stays as it is (form
``plain``), as does the share that the draws leave out. A NULL draw counts as 0. Texts may have any
length: a row needs a few bytes of masks per byte. Columns of ``docs`` that are named like a new one
are replaced; repeated rows give repeated results; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from shelfmark.llm.common import limit_batches

SENTINELS = "<P><S><M>"
PIECE = "struct<buffer:string,start:int,length:int>"

#: Forms and the places their pieces take from the document's order, which is
#: <P>, prefix, <M>, middle, <S>, suffix.
FORMS = {"psm": [0, 1, 4, 5, 2, 3], "spm": [4, 5, 0, 1, 2, 3]}
_MARKS = ["<P>", "<M>", "<S>"]

_STRIDE = 1 << 16


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Where units start in UTF-8 bytes: runs of ASCII letters, and every other character."""
    letter = ((raw | 0x20) - np.uint8(97)) < 26
    starts = (raw & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def nth_true(mask: np.ndarray, n: int) -> int:
    """Place of the ``n``-th true value, from 0; the length if there are no more than ``n``."""
    if not len(mask):
        return 0
    counts = np.cumsum(np.add.reduceat(mask, np.arange(0, len(mask), _STRIDE), dtype=np.int64))
    at = int(np.searchsorted(counts, n, side="right"))
    if at == len(counts):
        return len(mask)
    left = n - (int(counts[at - 1]) if at else 0)
    return at * _STRIDE + int(np.flatnonzero(mask[at * _STRIDE:(at + 1) * _STRIDE])[left])


def _cut(raw: np.ndarray, draws: tuple[int, int]) -> tuple[int, int, int, int, int]:
    starts = unit_starts(raw)
    n = int(np.count_nonzero(starts))
    first, second = (nth_true(starts, k) for k in sorted(d % (n + 1) for d in draws))
    inner = (raw & 0xC0) == 0x80
    return (n, first, second, first - int(np.count_nonzero(inner[:first])),
            second - first - int(np.count_nonzero(inner[first:second])))


_CUT = StructType([StructField("n", LongType()), StructField("first", IntegerType()),
                   StructField("second", IntegerType()), StructField("prefix_chars", LongType()),
                   StructField("middle_chars", LongType())])


@F.arrow_udf(_CUT)
def _cuts(text: pa.Array, draw1: pa.Array, draw2: pa.Array) -> pa.Array:
    found = [_cut(np.frombuffer(t.as_buffer() or b"", np.uint8), (a, b))
             for t, a, b in zip(text, draw1.to_pylist(), draw2.to_pylist())]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*found)) or [()] * 5
    return pa.StructArray.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        ["n", "first", "second", "prefix_chars", "middle_chars"])


@F.arrow_udf(StringType())
def _stream(text: pa.Array, pieces: pa.Array) -> pa.Array:
    sentinels, out = memoryview(SENTINELS.encode()), []
    sizes = pieces.value_lengths().to_pylist()
    flat = pieces.flatten()
    marked, starts, lengths = (flat.field(k).to_pylist() for k in range(3))
    at = 0
    for t, size in zip(text, sizes):
        whole, digest = memoryview(t.as_buffer() or b""), hashlib.sha256()
        for k in range(at, at + size):
            buffer = whole if marked[k] == "text" else sentinels
            digest.update(buffer[starts[k]:starts[k] + lengths[k]])
        at += size
        out.append(digest.hexdigest())
    return pa.array(out, pa.string())


def piece(buffer: str, start: Column | int, length: Column | int) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), F.lit(start).cast("int").alias("start"),
                    F.lit(length).cast("int").alias("length"))


def whole(text: Column) -> Column:
    """The piece table of an untouched text."""
    return F.array(piece("text", 0, F.octet_length(text)))


def split(text: Column, places: list[Column]) -> Column:
    """The untouched text's one descriptor split at the given bytes, which ascend."""
    ends = [F.lit(0), *places, F.octet_length(text)]
    return F.array(*(piece("text", a, b - a) for a, b in zip(ends, ends[1:])))


def with_sentinels(pieces: Column) -> Column:
    """A sentinel before each of prefix, middle and suffix."""
    marks = [piece("sentinel", SENTINELS.index(m), len(m)) for m in _MARKS]
    return F.array(*(p for k, m in enumerate(marks) for p in (m, pieces[k])))


def permute(pieces: Column, order: list[int]) -> Column:
    return F.array(*(pieces[k] for k in order))


def inverse(order: list[int]) -> list[int]:
    return [order.index(k) for k in range(len(order))]


def by_form(form: Column, value) -> Column:
    """``value(name, order)`` of the row's form; NULL for plain rows."""
    return reduce(lambda rest, x: F.when(form == x[0], value(*x)).otherwise(rest),
                  FORMS.items(), F.lit(None))


def render(pieces: Column, text: Column) -> Column:
    """The string that descriptors stand for."""
    buffers = {"text": text.cast("binary"), "sentinel": F.lit(SENTINELS).cast("binary")}
    part = lambda p: F.when(
        p["buffer"] == "text", F.substring(buffers["text"], p["start"] + 1, p["length"])
    ).otherwise(F.substring(buffers["sentinel"], p["start"] + 1, p["length"]))
    return F.array_join(F.transform(pieces, lambda p: part(p).cast("string")), "")


def digest(pieces: Column, text: Column) -> Column:
    """SHA-256 of the string that descriptors stand for, which is never built."""
    return _stream(F.coalesce(text, F.lit("")), pieces)


def fill_in_middle(docs: DataFrame, draws: list[Column], text: str = "text",
                   plain_from: int = 90, suffix_first_below: int = 20) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``pieces``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``draws`` are four whole numbers a row: two places for the cuts (modulo units + 1), one that
    keeps the row plain where it is ``plain_from`` or more modulo 100, one that puts the suffix
    first where it is below ``suffix_first_below`` modulo 100.
    """
    limit_batches(docs.sparkSession)
    new = ["n", "form", "pieces", "prefix_chars", "middle_chars", "output"]
    d = [F.coalesce(x.cast("bigint"), F.lit(0)).alias(f"d{k}") for k, x in enumerate(draws)]
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"), *d)
    held = reduce(Column.__or__, (F.contains("t", F.lit(m)) for m in _MARKS))
    plain = (F.col("t") == "") | held | (F.col("d2") % 100 >= plain_from)
    form = (F.when(plain, "plain").when(F.col("d3") % 100 < suffix_first_below, "spm")
            .otherwise("psm"))
    rows = rows.select("row", "t", form.alias("form"),
                       _cuts("t", F.col("d0"), F.col("d1")).alias("cut"))
    cut = F.col("cut")
    parts = with_sentinels(split(F.col("t"), [cut["first"], cut["second"]]))
    arranged = by_form(F.col("form"), lambda _, order: permute(parts, order))
    rows = rows.withColumn("pieces", F.coalesce(arranged, whole(F.col("t"))).cast(f"array<{PIECE}>"))
    moved = F.col("form") != "plain"
    return rows.select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in new),
        cut["n"].alias("n"), "form", "pieces",
        F.when(moved, cut["prefix_chars"]).alias("prefix_chars"),
        F.when(moved, cut["middle_chars"]).alias("middle_chars"),
        render(F.col("pieces"), F.col("t")).alias("output"))


def read_back(output: Column, form: Column) -> Column:
    """Descriptors over ``output`` in the document's own order, sentinels left out: found from the
    output and its form alone."""
    def restored(_, order):
        marks = [_MARKS[k // 2] for k in order if k % 2 == 0]
        at = [F.octet_length(F.substring_index(output, m, 1)) for m in marks]
        ends = [*at[1:], F.octet_length(output)]
        found = [p for m, a, e in zip(marks, at, ends)
                 for p in (piece("text", a, len(m)), piece("text", a + len(m), e - a - len(m)))]
        back = inverse(order)
        return F.array(*(found[k] for k in back if order[k] % 2 == 1))
    return F.coalesce(by_form(form, restored), whole(output)).cast(f"array<{PIECE}>")
