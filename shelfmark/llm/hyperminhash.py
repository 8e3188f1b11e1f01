"""Near-duplicate documents by HyperMinHash sketches, banded registers and exact confirmation.

Each document's word shingles are dealt to 128 buckets; a bucket keeps its smallest hash as a
count of leading zeros and some mantissa bits. Bands of four registers name candidate groups. Pairs
are weighed by the sketch's similarity, corrected for accidental register collisions, and confirmed
on the full shingle sets. Documents of one shingle set are one class from the start, so copies are
never paired.

Candidate groups are worked through without listing their pairs:

1. every member of a group is compared with the group's first member;
2. in groups that still hold several components, members go to blocks, and each pair of blocks is
   compared in one task, which returns spanning links only. A pair that meets in several groups is
   compared in the first of them.

Defined results: NULL, empty or blank text has an empty set and links with nothing; a text of fewer
words than a shingle is one shingle; repeated rows and ties fall into one class whose component is
the smallest id; rows with a NULL id take part but name no component; of each component one id and
text is kept, the smallest id first and NULL last; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.llm.common import limit_batches
from shelfmark.llm.components import components
from shelfmark.session import stage

REGISTERS = 128           # buckets of a sketch
BAND = 4                  # registers that name a candidate group together
BANDS = REGISTERS // BAND
MANTISSA_BITS = 16        # kept after the leading zeros
EMPTY = np.uint32(0xFFFFFFFF)
BLOCK = 512               # members that one side of a task compares
SIGMAS = 7.5              # so far below the threshold a pair at it falls with less than 1e-9
WORD_CACHE = 400_000      # word hashes that a task remembers

_DOWN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = b" \t\n\x0b\x0c\r"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9),
        np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text."""
    # bytes.split() without arguments splits at exactly space and 0x09-0x0D
    words = (text or "").encode("utf-8", "surrogatepass").translate(_DOWN).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = _mixed(out * _MIX[0] + h[k:k + n])
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch: per bucket the smallest hash as leading zeros and mantissa, or EMPTY."""
    out = np.full(REGISTERS, EMPTY, np.uint32)
    if len(shingles):
        shift = np.uint64(64 - (REGISTERS - 1).bit_length())
        bucket = (shingles >> shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the smallest
        rest = shingles[first] & ((np.uint64(1) << shift) - np.uint64(1))
        # the position of the top bit gives the leading zeros; the bits below it are the mantissa
        top = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
        top = np.where((top > 0) & ((rest >> np.maximum(top - 1, 0).astype(np.uint64)) == 0),
                       top - 1, top)  # rounding to a double may have carried upwards
        zeros = int(shift) - top
        down = np.maximum(top - 1 - MANTISSA_BITS, 0).astype(np.uint64)
        up = np.maximum(MANTISSA_BITS - top + 1, 0).astype(np.uint64)
        mantissa = ((rest >> down) << up) & np.uint64((1 << MANTISSA_BITS) - 1)
        out[bucket[first]] = ((zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS))
                              | mantissa).astype(np.uint32)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a (rows, REGISTERS) array; 0 where the whole band is empty."""
    bands = sketch.reshape(len(sketch), BANDS, BAND).astype(np.uint64)
    key = np.full(bands.shape[:2], np.uint64(7), np.uint64)
    for k in range(BAND):
        key = _mixed(key * _MIX[0] + bands[:, :, k])
    key = np.where(key == 0, np.uint64(1), key)
    return np.where((bands == EMPTY).all(axis=2), np.uint64(0), key)


def estimate(equal: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Similarity from equal and filled register counts, less the accidental collisions.

    Two different minima agree in leading zeros with probability 1/3 and in the mantissa with
    2^-MANTISSA_BITS.
    """
    chance = 2.0 ** -MANTISSA_BITS / 3
    share = equal / np.maximum(filled, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def passes(equal: np.ndarray, filled: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sketch leaves a pair possible, by a wide margin."""
    slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))
    return estimate(equal, filled) >= threshold - slack


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    both = _shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def row_key(docs: DataFrame) -> Column:
    """Names rows by id and text: ids may be NULL or stand on several texts."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles, set_key (128 bits of the whole set), sketch; one row per document."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "row": batch["row"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "sketch": [registers(s).tobytes() for s in sets]})

    return docs.select("doc_id", "text", row_key(docs).alias("row")).mapInPandas(
        run, "doc_id bigint, row bigint, n_shingles bigint, set_key binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """class_id, band, band_key for every band that is not empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sketch = np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(-1, REGISTERS)
                keys = band_keys(sketch)
                row, band = np.nonzero(keys)
                yield pd.DataFrame({"class_id": batch["class_id"].to_numpy()[row],
                                    "band": band.astype(np.int32),
                                    "band_key": keys[row, band].astype(np.int64)})

    return classes.mapInPandas(run, "class_id bigint, band int, band_key bigint")


_GROUP = ["band", "band_key"]


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class_id, sketch, shingles (sorted 64-bit numbers as bytes) of the classes ``wanted``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch["text"]]
            yield pd.DataFrame({"class_id": batch["class_id"],
                                "sketch": [registers(s).tobytes() for s in sets],
                                "shingles": [s.tobytes() for s in sets]})

    named = (docs.select(row_key(docs).alias("class_id"), "text").join(wanted, "class_id")
             .dropDuplicates(["class_id"]))
    return stage(named.mapInPandas(run, "class_id bigint, sketch binary, shingles binary"), "sets")


def _compare_with_leader(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links among (class_id, leader) pairs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_alike(np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32),
                           np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for s, t, x, y in zip(batch["sketch"], batch["leader_sketch"],
                                          batch["shingles"], batch["leader_shingles"])]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    leaders = sets.select(F.col("class_id").alias("leader"),
                          F.col("sketch").alias("leader_sketch"),
                          F.col("shingles").alias("leader_shingles"))
    both = pairs.join(sets, "class_id").join(leaders, "leader").select(
        F.col("class_id").alias("a"), F.col("leader").alias("b"), "sketch", "leader_sketch",
        "shingles", "leader_shingles")
    return both.mapInPandas(run, "a bigint, b bigint")


def _alike(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    filled = np.array([((s != EMPTY) | (t != EMPTY)).sum()])
    equal = np.array([((s == t) & (s != EMPTY)).sum()])
    return bool(passes(equal, filled, percent / 100)[0]) and similar(x, y, percent)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def block_links(left: pd.DataFrame, right: pd.DataFrame, band: int, percent: int) -> list[tuple]:
    """Spanning links between two blocks of one group, or within one (``right`` is ``left``).

    Both blocks hold class_id, component, sketch and shingles. Skips pairs of one component, pairs
    that share an earlier band, and pairs that links found here already connect.
    """
    same = right is left
    sk = [np.frombuffer(b"".join(x["sketch"]), np.uint32).reshape(-1, REGISTERS)
          for x in (left, right)]
    sets = [[np.frombuffer(b, np.uint64) for b in x["shingles"]] for x in (left, right)]
    ids = [x["class_id"].tolist() for x in (left, right)]
    part = [x["component"].to_numpy() for x in (left, right)]
    nodes = {c: i for i, c in enumerate(dict.fromkeys([*part[0].tolist(), *part[1].tolist()]))}
    parent, found = list(range(len(nodes))), []
    earlier = band_keys(sk[0])[:, :band], band_keys(sk[1])[:, :band]
    full = sk[1] != EMPTY
    for i in range(len(ids[0])):
        start = i + 1 if same else 0
        if start >= len(ids[1]):
            continue
        other = np.flatnonzero(part[1][start:] != part[0][i]) + start
        if band:
            met = ((earlier[1][other] == earlier[0][i]) & (earlier[0][i] != 0)).any(axis=1)
            other = other[~met]
        equal = ((sk[1][other] == sk[0][i]) & full[other]).sum(axis=1)
        filled = (full[other] | (sk[0][i] != EMPTY)).sum(axis=1)
        mine = nodes[part[0][i].item()]
        for j in other[passes(equal, filled, percent / 100)].tolist():
            a, b = _root(parent, mine), _root(parent, nodes[part[1][j].item()])
            if a != b and similar(sets[0][i], sets[1][j], percent):
                parent[a] = b
                found.append((ids[0][i], ids[1][j]))
    return found


def _compare_rest(open_groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within a group, block by block.

    ``open_groups``: band, band_key, class_id, component, and per group the largest component
    ``main`` with its ``settled`` members and the number of ``others``. Members of the main
    component need no comparison among themselves: they are dealt to blocks of their own, which
    meet the blocks of the others only. Every pair of blocks is one group of the last shuffle, so
    no task gets more than two blocks at a time.
    """
    def blocks(n: str):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    own = F.when(F.col("component") == F.col("main"),
                 F.col("o") + F.pmod(F.xxhash64("class_id"), F.col("s")))
    dealt = (open_groups.withColumns({"s": blocks("settled"), "o": blocks("others")})
             .withColumn("block", F.coalesce(own, F.pmod(F.xxhash64("class_id"), F.col("o")))
                         .cast("int")))
    partners = F.when(F.col("block") < F.col("o"), F.col("o") + F.col("s")).otherwise(F.col("o"))
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
    rows = copies.select(
        *_GROUP, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "class_id", "component").join(sets, "class_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        left = group[group["block"] == low]
        right = left if low == high else group[group["block"] == high]
        links = block_links(left, right, int(group["band"].iloc[0]), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy(*_GROUP, "low", "high").applyInPandas(run, "a bigint, b bigint")


def links_between_classes(docs: DataFrame, classes: DataFrame, width: int,
                          percent: int) -> DataFrame:
    """``a``, ``b``: links that connect every component of the class graph."""
    bands = _bands(classes)
    groups = (bands.groupBy(*_GROUP)
              .agg(F.min("class_id").alias("leader"), F.count(F.lit(1)).alias("members"))
              .filter(F.col("members") > 1))
    members = stage(bands.join(groups, _GROUP), "bands")
    sets = _sets(docs, members.select("class_id").distinct(), width)
    pairs = (members.filter(F.col("class_id") != F.col("leader"))
             .select("class_id", "leader").distinct())
    first = stage(_compare_with_leader(pairs, sets, percent), "links")
    known = stage(components(first), "components")
    # In a group of two the one pair is compared already.
    placed = (members.filter(F.col("members") > 2).join(
        known.withColumnRenamed("id", "class_id"), "class_id", "left")
        .withColumn("component", F.coalesce("component", "class_id")))
    still_open = (placed.groupBy(*_GROUP, "component").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy(*_GROUP).agg(F.max_by("component", F.struct("n", "component"))
                                        .alias("main"), F.max("n").alias("settled"),
                                        F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
                  .filter(F.col("parts") > 1)
                  .select(*_GROUP, "main", "settled", (F.col("all") - F.col("settled"))
                          .alias("others")))
    rest = _compare_rest(placed.join(still_open, _GROUP).drop("leader", "members"), sets, percent)
    return first.union(rest)


def grouped_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept; one row per row of ``docs`` (doc_id, text, ...).

    ``row`` is the row_key; equal rows have one and are kept or not together.
    """
    rows = stage(sketches(docs, width), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = stage(rows.filter(F.col("n_shingles") > 0)
                    .groupBy("set_key").agg(F.min("row").alias("class_id"),
                                            F.min(first).alias("first"),
                                            F.first("sketch").alias("sketch")), "classes")
    links = links_between_classes(docs, classes.select("class_id", "sketch"), width, percent)
    # classes without a link are components of their own
    linked = classes.select("class_id", "first").join(
        stage(components(links), "grouped").withColumnRenamed("id", "class_id"), "class_id")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    heads = linked.join(heads, "component").select("class_id", "head")
    placed = classes.select("set_key", "class_id", "first").join(heads, "class_id", "left").select(
        "set_key", F.coalesce("head", "first").alias("head"))
    found = rows.drop("sketch").join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("head.doc_id", "doc_id"))
    return found.select("doc_id", "row", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs`` (doc_id, text, ...)."""
    return grouped_rows(docs, width, percent).drop("row")
