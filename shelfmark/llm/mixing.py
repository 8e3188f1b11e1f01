"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's wanted copies are its source's target over its
size; the whole copies are certain, the rest of them is its inclusion probability for one copy more.
Those copies go in the order of random odds over inclusion odds, up to the words that the certain
copies leave open, so a source's sample has a fixed size in words and not only on average. The
words still open below the next document go to the largest document that fits, then to the one that
comes nearest (``CLOSERS``).

No source is gathered in one task: ranks are cut by counts of words per digit of the rank, two
digits deep, and only documents that agree in both are put in order. Numbers are taken from a hash
of seed, id and text, so that runs agree; rows equal in both share a place and are told apart by
number. NULL text has size 0 and no copies matter; NULL sources are one source, ordered last; no
rows give no rows. A source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import stage

WORD = r"[^\x20\x09-\x0D]+"

#: Ranks below 1 are cut into DIGIT parts, and each of these again.
DIGIT = 1 << 14

#: Documents that close the gap below the first one that does not fit.
CLOSERS = 2

#: A table of sources with no more rows and bytes than these is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def in_turn(weights: list[int]) -> Callable[[Column], Column]:
    """Weights by place of the source, repeating."""
    return lambda place: F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))


def targets(sizes: DataFrame, weight: Callable[[Column], Column], cap: int = 3) -> DataFrame:
    """``source, source_size`` with ``target``: all words shared by weight, none above ``cap`` times
    its source. What a capped source leaves is shared again by weight, which raises one level of
    words per weight until it holds all words.

    Sources are capped in the order of their cap per weight, so one pass over them finds the level.
    One row per source passes through one task, never rows of documents.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    placed = sizes.withColumn("place", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = (placed.withColumn("weight", weight(F.col("place")).cast("bigint"))
              .withColumn("most", cap * F.col("source_size"))
              .withColumn("all_words", F.sum("source_size").over(every)))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = placed.withColumn("left", left).withColumn("weights", F.sum("weight").over(after))
    level = level.withColumn("full", F.col("most") * F.col("weights") <= F.col("weight") * F.col("left"))
    rest = level.withColumn("shared", F.min(F.when(~F.col("full"), F.struct(
        F.col("most") / F.col("weight"), "place", "left", "weights"))).over(every))
    share = (F.col("weight") * F.col("shared.left")).cast("double") / F.col("shared.weights")
    return rest.select("source", "source_size", F.when(
        F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _small(df: DataFrame) -> bool:
    size = df.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("b")).first()
    return size.n <= BROADCAST_ROWS and size.b <= BROADCAST_BYTES


def _crossing(rows: DataFrame, keys: list[str], digit: str, state: DataFrame) -> DataFrame:
    """Per source the first ``digit`` at which the words of its rows pass ``open``, which is lowered
    by the words before it. Sources whose rows all fit have no row."""
    order = Window.partitionBy(*keys).orderBy(digit)
    sums = rows.groupBy(*keys, digit).agg(F.sum("size").alias("words"))
    run = sums.withColumn("upto", F.sum("words").over(order))
    run = run.join(state, keys).filter(F.col("upto") > F.col("open"))
    first = run.groupBy(*keys).agg(F.min(F.struct(digit, "upto", "words", "open")).alias("c"))
    return first.select(*keys, F.col(f"c.{digit}").alias(digit),
                        (F.col("c.open") - (F.col("c.upto") - F.col("c.words"))).alias("open"))


def mix(docs: DataFrame, weight: Callable[[Column], Column], cap: int = 3, seed: str = "mix",
        text: str = "text", doc_id: str = "doc_id", source: str = "source",
        preference: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, by default all) with ``size``, ``source_size``,
    ``target``, ``copies`` and ``taken``, the words of all copies. Kept columns of these names are
    replaced.

    ``preference`` scales a document's wanted copies (1 for all by default), which makes inclusion
    probabilities unequal within a source too; no document gets more than ``cap`` copies.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                            F.lit(":"), F.coalesce(F.col(text), F.lit(""))), 256)
    number = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("bigint")
    rows = stage(docs.select(
        F.struct(*kept).alias("row") if kept else F.lit(None).cast("int").alias("row"),
        F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        ((number + 0.5) / float(1 << 52)).alias("u"),
        (preference if preference is not None else F.lit(1.0)).cast("double").alias("preference"),
        F.monotonically_increasing_id().alias("rid")), "mix-rows")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(targets(sizes, weight, cap), "mix-targets")
    # a key without NULL, so that plain joins find the NULL source too
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    goal = goal.withColumn("key", key)
    few = _small(goal)

    def per_source(df):
        return F.broadcast(df) if few else df

    wanted = F.when(F.col("source_size") > 0, F.least(
        F.lit(float(cap)), F.col("target") / F.col("source_size") * F.col("preference")))
    wanted = F.coalesce(wanted, F.lit(0.0))
    odds = F.col("u") / (1 - F.col("u"))
    ranked = rows.withColumn("key", key).drop("source").join(per_source(goal), "key")
    ranked = ranked.withColumn("wanted", wanted).withColumn("sure", F.floor("wanted"))
    part = F.col("wanted") - F.col("sure")
    q = odds / (part / (1 - part))
    ranked = ranked.withColumn("p", F.when(part > 0, q / (1 + q)).otherwise(F.lit(1.0)))
    cell = F.least(F.floor(F.col("p") * DIGIT * DIGIT), F.lit(DIGIT * DIGIT - 1)).cast("bigint")
    ranked = (ranked.withColumn("high", F.shiftright(cell, 14)).withColumn("low", cell % DIGIT))

    sure = ranked.groupBy("key").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_words"))
    state = goal.join(sure, "key").select("key", (F.col("target") - F.col("sure_words")).alias("open"))
    state = stage(state, "mix-state")
    free = ranked.filter(F.col("sure") < cap)
    high = stage(_crossing(free, ["key"], "high", per_source(state)), "mix-high")
    inside = free.join(per_source(high.select("key", "high")), ["key", "high"], "left_semi")
    low = stage(_crossing(inside, ["key", "high"], "low", per_source(high)), "mix-low")

    # rows of the last cell in order: the last one that still fits is the cut
    place = F.struct("p", "u", "rid")
    last = inside.join(per_source(low.select("key", "high", "low")), ["key", "high", "low"], "left_semi")
    run = Window.partitionBy("key").orderBy("p", "u", "rid")
    last = last.withColumn("upto", F.sum("size").over(run)).join(per_source(low), ["key", "high", "low"])
    cut = last.filter(F.col("upto") <= F.col("open")).groupBy("key").agg(F.max(place).alias("cut"))
    ends = low.withColumn("cell", F.col("high") * DIGIT + F.col("low")).select("key", "cell")
    ends = stage(ends.join(cut, "key", "left"), "mix-cut")

    cell = F.col("high") * DIGIT + F.col("low")
    taken = F.col("cell").isNull() | (cell < F.col("cell")) | (
        (cell == F.col("cell")) & F.coalesce(place <= F.col("cut"), F.lit(False)))
    chosen = ranked.join(per_source(ends), "key", "left").withColumn(
        "more", (F.col("sure") < cap) & taken)

    closers = None
    for k in range(CLOSERS):
        chosen_now = chosen if closers is None else chosen.join(
            per_source(closers), "key", "left").withColumn(
            "more", F.col("more") | F.coalesce(F.array_contains("rids", F.col("rid")), F.lit(False)))
        spent = chosen_now.filter("more").groupBy("key").agg(F.sum("size").alias("spent"))
        gap = state.join(spent, "key", "left").select(
            "key", (F.col("open") - F.coalesce("spent", F.lit(0))).alias("gap"))
        able = chosen_now.filter(~F.col("more") & (F.col("sure") < cap) & (F.col("size") > 0))
        away = F.abs(F.col("gap") - F.col("size"))
        fits = away < F.col("gap") if k == CLOSERS - 1 else F.col("size") <= F.col("gap")
        best = (able.join(per_source(gap), "key").filter(fits)
                .groupBy("key").agg(F.min(F.struct(away.alias("away"), "p", "u", "rid")).alias("b")))
        found = best.select("key", F.array("b.rid").alias("found"))
        if closers is not None:
            found = closers.join(found, "key", "full").select("key", F.concat(
                F.coalesce("rids", F.array().cast("array<bigint>")),
                F.coalesce("found", F.array().cast("array<bigint>"))).alias("found"))
        closers = stage(found.withColumnRenamed("found", "rids"), "mix-closers")

    done = chosen.join(per_source(closers), "key", "left")
    more = F.col("more") | F.coalesce(F.array_contains("rids", F.col("rid")), F.lit(False))
    copies = (F.col("sure") + more.cast("bigint")).alias("copies")
    return done.select(*(F.col("row")[c].alias(c) for c in kept), "size", "source_size", "target",
                       copies, (copies * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies."""
    return (mixed.filter(F.col("copies") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
