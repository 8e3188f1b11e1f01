"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some tokens of a stretch and ignore the others, so a stretch still gives the same
hash after a substitution at an ignored place. The hashes of all benchmark stretches are joined with
those of all document stretches. Around each hit the document is laid against the item at that
offset, and the overlap is verified: within some window of ``window`` tokens (or the whole item, if
it is shorter) at least ``percent`` of a hundred tokens must be equal. At the default values the
masks hit every overlap that this rule allows; a lower percentage is held only as far as they hit.

Column expressions only. Tokens are hashed once per document; stretches are generated, hashed and
joined in one stage and leave it only as hits. Benchmark items with equal tokens are one class.
The seeds are broadcast if they were counted to be at most BROADCAST_SEEDS; beyond that the same
join goes through a shuffle.

Tokens are runs of letters and digits of the lower-cased text. Defined results: NULL or empty texts
match nothing; items of fewer than MIN_TOKENS tokens are too short to tell and match nothing; items
shorter than the masks match where all their tokens stand in order, found by one seed of their own
length; repeated rows and rows with a NULL id are judged each for itself; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import stage

# Token offsets that the masks look at. Weight 6, spans of 7 to 11. Found by exhaustive
# search: each way to substitute 2 of 11, 3 of 15 or 4 of 20 tokens leaves one of them whole at some
# place, and so does every overlap that WINDOW and PERCENT allow for items of 11 tokens and more.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 1, 5, 8, 9, 10), (0, 1, 2, 6, 8, 9))
SPAN = 11
MIN_TOKENS = 6  # items of fewer tokens are met by chance too often
WINDOW = 20
PERCENT = 80
BROADCAST_SEEDS = 1_000_000  # rows of two numbers, an item and an offset: some 50 MB


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(tokens: str, at: str, masks: list[tuple[int, ...]]) -> Column:
    """One hash per mask for the stretch at a position, NULL where it runs over the end."""
    return F.array(*[F.when(
        F.col(at) + max(mask) < F.size(tokens),
        F.xxhash64(F.lit(i), *[F.get(F.col(tokens), F.col(at) + o) for o in mask]))
        for i, mask in enumerate(masks)])


def _stretches(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """``rows`` (with tokens) times position ``at`` times mask: column ``seed``."""
    last = F.size("tokens") - min(max(m) + 1 for m in masks)
    placed = rows.filter(last >= 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return placed.withColumn("seed", F.explode(_seeds("tokens", "at", masks))).filter(
        F.col("seed").isNotNull())


def _best_window(same: Column, size: Column) -> Column:
    """Most equal tokens in any ``size`` consecutive ones, by a running sum."""
    late = F.concat(F.array_repeat(F.lit(0), size), same)  # what leaves the window at each step
    change = F.zip_with(same, F.slice(late, F.lit(1), F.size(same)), lambda x, y: x - y)
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(change, state, lambda acc, x: F.struct(
        (acc["now"] + x).alias("now"), F.greatest(acc["best"], acc["now"] + x).alias("best")))[
        "best"]


def _need(size: Column, percent: int) -> Column:
    """Tokens that must be equal: ``percent`` of ``size``, rounded up."""
    return F.floor((size * percent + 99) / 100)


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item (smallest id), items (all ids), tokens: one row per distinct token sequence."""
    return (benchmark.filter(F.col("item_id").isNotNull())
            .select("item_id", token_hashes(F.col("text")).alias("tokens"))
            .groupBy("tokens").agg(F.min("item_id").alias("item"),
                                   F.sort_array(F.collect_set("item_id")).alias("items"))
            .filter(F.size("tokens") >= MIN_TOKENS))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
             percent: int = PERCENT) -> DataFrame:
    """doc_id, body, item, at (token of the document), matched, item_tokens: verified overlaps.

    One row per document, item class and place; ``body`` is the hash of the text.
    """
    items = stage(item_classes(benchmark), "items")
    short = [r["n"] for r in items.filter(F.size("tokens") < SPAN)
             .select(F.size("tokens").alias("n")).distinct().orderBy("n").collect()]
    masks = [*MASKS, *(tuple(range(n)) for n in short)]  # at most SPAN - MIN_TOKENS more
    seeds = stage(_stretches(items.select("item", "tokens"), masks).select(
        "seed", "item", F.col("at").alias("item_at"), F.size("tokens").alias("n")), "seeds")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("body"),
                         token_hashes(F.col("text")).alias("tokens"))
    key = ["doc_id", "body", "item", "n", (F.col("at") - F.col("item_at")).alias("at")]
    if seeds.count() <= BROADCAST_SEEDS:
        hits = _stretches(tokens, masks).join(F.broadcast(seeds), "seed").select(*key, "tokens")
    else:  # no text travels with the stretches; documents with hits are read again
        narrow = _stretches(tokens, masks).select("doc_id", "body", "at", "seed")
        met = narrow.join(seeds, "seed").select(*key).distinct().withColumnsRenamed(
            {"doc_id": "hit_id", "body": "hit_body"})
        hits = tokens.join(met, F.col("doc_id").eqNullSafe(F.col("hit_id"))
                           & (F.col("body") == F.col("hit_body"))).drop("hit_id", "hit_body")
    return _verified(hits, items, window, percent)


def _verified(hits: DataFrame, items: DataFrame, window: int, percent: int) -> DataFrame:
    """Hits whose overlap holds; the part of the document that an item covers is cut out first."""
    start = F.greatest(F.col("at"), F.lit(0))
    size = F.least(F.size("tokens"), F.col("at") + F.col("n")) - start
    cut = hits.select("doc_id", "body", "item", "at", (start - F.col("at")).alias("skip"),
                      F.slice("tokens", start + 1, size).alias("part"))
    once = cut.groupBy("doc_id", "body", "item", "at", "skip").agg(F.first("part").alias("part"))
    both = once.join(items.select("item", F.col("tokens").alias("item_tokens")), "item")
    same = F.zip_with("part", F.slice("item_tokens", F.col("skip") + 1, F.size("part")),
                      lambda x, y: F.when(x == y, 1).otherwise(0))
    span = F.least(F.lit(window), F.size("item_tokens"))
    found = both.withColumn("matched", _best_window(same, span))
    need = F.when(F.size("item_tokens") < SPAN, F.size("item_tokens")).otherwise(
        _need(span, percent))
    return found.filter(F.col("matched") >= need).select(
        "doc_id", "body", "item", "at", "matched", F.size("item_tokens").alias("item_tokens"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  percent: int = PERCENT) -> DataFrame:
    """All columns of ``docs`` and item_ids (sorted ids of the items found, empty if clean)."""
    found = overlaps(docs, benchmark, window, percent)
    named = found.select("doc_id", "body", "item").distinct().join(
        item_classes(benchmark).select("item", "items"), "item")
    lists = (named.groupBy("doc_id", "body")
             .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
             .select(F.col("doc_id").alias("__id"), F.col("body").alias("__found"), "ids"))
    own = [c for c in docs.columns if c != "item_ids"]
    return docs.select(*own, F.xxhash64("text").alias("__body")).join(
        lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__found")),
        "left").select(*own, F.coalesce("ids", F.array().cast("array<bigint>")).alias("item_ids"))
