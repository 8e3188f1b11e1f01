"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that one Arrow batch may hold at most. Texts are whole, so a batch must stay small.
BATCH_ROWS = 1000

PIECE = 256  # items that ``running`` folds at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. Lowers the session's setting, never raises it.

    The engine reads this setting when a plan runs, so it has to stay lowered for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(items: Column, zero: Column, kind: str, fold: Callable[[Column, Column], Column]) -> Column:
    """array<kind>: for each item the fold over all items before it; NULL for a NULL array.

    An array that grows item by item is copied every time, so states are first taken at the pieces
    of ``PIECE`` items and then within each piece.
    """
    none, states = F.array().cast(f"array<{kind}>"), f"struct<at:{kind},out:array<{kind}>>"

    def scan(parts: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(
            parts, F.struct(start.alias("at"), none.alias("out")).cast(states),
            lambda acc, x: F.struct(step(acc["at"], x).cast(kind).alias("at"), F.concat(
                acc["out"], F.array(acc["at"])).alias("out")).cast(states))["out"]

    def pieces(held: Column) -> Column:
        count = F.greatest(F.ceil(F.size(held) / PIECE), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1),
                          lambda k: F.slice(held, k * PIECE + 1, F.lit(PIECE)))
        return F.when(held.isNotNull(), cut)

    def folds(held: Column) -> Column:
        starts = scan(held, zero, lambda at, piece: F.aggregate(
            piece, at, lambda a, x: fold(a, x).cast(kind)))
        return F.flatten(F.zip_with(held, starts, lambda piece, at: scan(piece, at, fold)))

    return bound(bound(items, pieces), folds)
