"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A vector is turned by fast Hadamard rotations with random signs; the nearest signed axis is its
hash. HASHES of them name its bucket in a table, and it also visits the PROBES next likely buckets.
Every candidate pair is verified by its cosine in double precision. Equal vectors of a label are one
class from the start, so copies are never paired.

Buckets are compared in blocks of at most BLOCK members, one pair of blocks per task group. Tasks
return link counts and spanning links, never the pairs. A pair that meets in several buckets counts
in the first of them only.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and
vectors with a NULL label, link with nothing and keep themselves; vectors of different length are
never compared; a NULL vec_id links with nothing (component NULL, kept); extra columns are ignored.
Every row is a vector of its own: rows that share a vec_id are told apart by label and vector, and
repeated rows link with each other. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.components import components
from shelfmark.session import stage

TABLES = 12    # pairs at the threshold meet in well over half of them
HASHES = 3     # signed axes that name a bucket: (2 * dimension)^3 buckets per table and label
PROBES = 2     # further buckets that a vector visits
TURNS = 3      # sign flips and Hadamard transforms per hash
SEED = 20_240_607
BLOCK = 512    # members that one side of a task compares


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        x = x.reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that no square overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home bucket per table (rows, TABLES) and visited ones (rows, TABLES, PROBES)."""
    rows, dim = units.shape
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :dim] = units
    signs = np.random.default_rng(SEED)
    at = np.arange(rows)
    home = np.empty((rows, TABLES), np.int64)
    visits = np.empty((rows, TABLES, PROBES), np.int64)
    for t in range(TABLES):
        code, steps, gaps = np.zeros(rows, np.int64), [], []
        for k in range(HASHES):
            y = padded
            for _ in range(TURNS):
                y = hadamard(y * signs.choice([-1.0, 1.0], width))
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :PROBES + 1]
            axes = best * 2 + np.take_along_axis(y < 0, best, axis=1)
            code += axes[:, 0] * (2 * width) ** k
            for p in range(1, best.shape[1]):  # the next nearest axis instead of the nearest
                steps.append((axes[:, p] - axes[:, 0]) * (2 * width) ** k)
                gaps.append(size[at, best[:, 0]] - size[at, best[:, p]])
        home[:, t] = code
        least = np.argsort(np.stack(gaps, 1), axis=1, kind="stable")[:, :PROBES]
        visits[:, t, :] = code[:, None] + np.take_along_axis(np.stack(steps, 1), least, axis=1)
    return home, visits


def _is_vector(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def _hashed(classes: DataFrame) -> DataFrame:
    """classes with home and visits (64-bit numbers as bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len), sort=False):
                units = unit(np.stack([np.asarray(v, np.float64) for v in part["vector"]]))
                home, visits = buckets(units)
                out = part[["class_id", "label", "copies", "low_id", "vector"]].copy()
                out["home"] = [h.tobytes() for h in home]
                out["visits"] = [v.tobytes() for v in visits]
                yield out

    kind = classes.schema["vector"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    return classes.mapInPandas(run, f"class_id bigint, label {label}, copies bigint, "
                                    f"low_id bigint, vector {kind}, home binary, visits binary")


_GROUP = ["label", "width", "t", "code"]


def _members(hashed: DataFrame) -> DataFrame:
    """One row per bucket that a class lives in or visits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            home = np.frombuffer(b"".join(batch["home"]), np.int64).reshape(-1, TABLES, 1)
            visits = np.frombuffer(b"".join(batch["visits"]), np.int64)
            codes = np.concatenate([home, visits.reshape(-1, TABLES, PROBES)], axis=2)
            each = TABLES * (PROBES + 1)
            yield pd.DataFrame({
                "label": batch["label"].repeat(each), "width": batch["width"].repeat(each),
                "t": np.tile(np.repeat(np.arange(TABLES), PROBES + 1), len(batch)),
                "code": codes.reshape(-1),
                "lives": np.tile(np.arange(PROBES + 1) == 0, len(batch) * TABLES),
                "class_id": batch["class_id"].repeat(each)})

    label = hashed.schema["label"].dataType.simpleString()
    return hashed.select("label", F.size("vector").alias("width"), "class_id", "home",
                         "visits").mapInPandas(
        run, f"label {label}, width int, t int, code bigint, lives boolean, class_id bigint")


def _met(home_a, visits_a, home_b, visits_b):
    """Pairs whose buckets touch in one table: (rows a, rows b)."""
    met = home_a[:, None] == home_b[None, :]
    for p in range(PROBES):
        met |= home_a[:, None] == visits_b[None, :, p]
        met |= visits_a[:, p, None] == home_b[None, :]
    return met


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame, table: int,
                   threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The links whose first meeting is here: (rows left, rows right), and spanning links."""
    u, home, visits, ids, lives = [], [], [], [], []
    for side in (left, right):
        u.append(unit(np.stack([np.asarray(v, np.float64) for v in side["vector"]])))
        home.append(np.frombuffer(b"".join(side["home"]), np.int64).reshape(-1, TABLES))
        visits.append(np.frombuffer(b"".join(side["visits"]), np.int64)
                      .reshape(-1, TABLES, PROBES))
        ids.append(side["class_id"].to_numpy())
        lives.append(side["lives"].to_numpy(bool))
    linked = u[0] @ u[1].T >= threshold
    linked &= lives[0][:, None] | lives[1][None, :]
    if right is left:
        linked &= np.tri(len(linked), k=-1, dtype=bool)
    if linked.any():
        for t in range(table):
            linked &= ~_met(home[0][:, t], visits[0][:, t], home[1][:, t], visits[1][:, t])
        # Neither lives with the other but each visits the other: counts where the smaller lives.
        a, b = home[0][:, table], home[1][:, table]
        both = ((a[:, None] != b[None, :])
                & (visits[0][:, table, :, None] == b[None, None, :]).any(axis=1)
                & (a[:, None, None] == visits[1][None, :, table, :]).any(axis=2))
        smaller_lives = np.where(ids[0][:, None] < ids[1][None, :], lives[0][:, None],
                                 lives[1][None, :])
        linked &= ~both | smaller_lives
    n = len(ids[0])
    near = np.zeros((n + len(ids[1]),) * 2, bool)
    near[:n, n:] = linked
    near |= near.T
    every = np.concatenate(ids)
    near |= every[:, None] == every[None, :]  # a block compared with itself
    low, before = every.copy(), None
    if linked.any():
        top = np.iinfo(np.int64).max
        while before is None or (low != before).any():
            before = low
            low = np.where(near, low[None, :], top).min(axis=1)
    spans = {(int(i), int(j)) for i, j in zip(every, low) if i != j}
    return linked, sorted(spans)


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """kind 0: class a has n links (copies counted) here; kind 1: a and b are linked."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        left = group[group["block"] == low]
        right = left if low == high else group[group["block"] == high]
        if not len(left) or not len(right):
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        linked, spans = compare_blocks(left, right, int(group["t"].iloc[0]), threshold)
        out = [(0, int(i), int(n)) for side, counts in (
            (left, linked @ right["copies"].to_numpy()), (right, left["copies"].to_numpy() @ linked))
            for i, n in zip(side["class_id"], counts) if n]
        return pd.DataFrame(out + [(1, a, b) for a, b in spans], columns=["kind", "a", "b"],
                            dtype="int64")

    return rows.groupBy(*_GROUP, "low", "high").applyInPandas(run, "kind bigint, a bigint, b bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``vectors``.

    ``vectors``: vec_id, embedding (array of float or double), label (any comparable type).
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.when(_is_vector(F.col("embedding")) & F.col("vec_id").isNotNull()
                                  & F.col("label").isNotNull(), F.col("embedding")).alias("vector"))
    classes = (rows.filter(F.col("vector").isNotNull()).groupBy("label", "vector")
               .agg(F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("copies")))
    # a class has a number of its own, because ids may repeat; staged, so that it stays the same
    hashed = stage(_hashed(classes.withColumn("class_id", F.monotonically_increasing_id())), "vectors")
    members = stage(_members(hashed), "buckets")
    shared = (members.groupBy(*_GROUP)
              .agg(F.count(F.lit(1)).alias("members"), F.max("lives").alias("lived_in"))
              .filter((F.col("members") > 1) & F.col("lived_in")).drop("lived_in"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (members.join(shared, _GROUP).withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*_GROUP, F.least("block", "other").alias("low"),
                     F.greatest("block", "other").alias("high"), "block", "lives", "class_id"))
    found = stage(_compare(dealt.join(hashed.drop("label"), "class_id"), threshold), "found")
    counts = (found.filter(F.col("kind") == 0).groupBy(F.col("a").alias("class_id"))
              .agg(F.sum("b").alias("links")))
    grouped = components(found.filter(F.col("kind") == 1).select("a", "b")).select(
        F.col("id").alias("class_id"), F.col("component"))
    linked = stage(hashed.select("class_id", "low_id").join(grouped, "class_id"), "linked")
    lowest = linked.groupBy("component").agg(F.min("low_id").alias("lowest"))
    linked = linked.join(lowest, "component").select("class_id", "lowest")
    known = (hashed.select("label", "vector", "class_id", "low_id", "copies")
             .join(counts, "class_id", "left").join(linked, "class_id", "left"))
    able = F.col("vector").isNotNull()
    named = rows.filter(able).join(known, ["label", "vector"])
    component = F.coalesce("lowest", "low_id")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    found = named.select("vec_id", links.cast("bigint").alias("n_links"),
                         component.alias("component_id"),
                         (F.col("vec_id") == component).alias("kept"))
    alone = rows.filter(~able).select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                      F.col("vec_id").alias("component_id"),
                                      F.lit(True).alias("kept"))
    return found.unionByName(alone)
