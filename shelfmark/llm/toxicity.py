"""Toxicity: a linear classifier whose scores may not change when identity terms are swapped.

Features are the distinct words of a whole text and the beginnings of its longer words, hashed.
Each labelled text that names a group also comes with the name swapped for another of its kind;
training adds the squared score change between the two to its loss, so that naming a group alone
moves no score, whatever the labels suggest.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE_ROWS); every text is scored
whole. Defined results: NULL and empty texts get the score of a text without features; several
labels of one id each count as a row; rows with a NULL label or id are not learned from; with no
labelled row every score is 0; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import limit_batches
from shelfmark.session import stage

SAMPLE_ROWS = 20_000   # labelled rows the classifier is fitted on, at most
SPACE = 1 << 21        # hashed features
KEPT_FEATURES = 8_192  # of the highest evidence; the size of the model that tasks get
STARTS = (4, 5, 6)     # beginnings of longer words that are features of their own
STEPS = 400
RATE = 0.5
RIDGE = 1e-4
FAIRNESS = 1.0         # weight of the squared score change under a swap of identity terms

# Names of groups. A name is swapped for the next one of its line.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "native"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("african", "american", "european", "chinese", "mexican", "indian"),
    ("immigrants", "refugees", "citizens", "locals"),
    ("old", "young"), ("disabled", "blind", "deaf"),
)
_SWAP = {term: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, term in enumerate(line)}
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def feature_strings(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)]


def features(found: set[str]) -> np.ndarray:
    """Sorted distinct hashed features of a set of words."""
    return np.array(sorted({zlib.crc32(f.encode()) % SPACE for w in found
                            for f in feature_strings(w)}), np.int32)


def swapped(found: set[str]) -> set[str]:
    """The same words with every identity term swapped for another of its kind."""
    return {_SWAP.get(w, w) for w in found}


class Model:
    """Weights of hashed features and an intercept."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def scorer(self):
        """A function from texts to scores; remembers what recent words add."""
        weights, known = self.weights, {}

        def parts(word: str) -> tuple:
            if len(known) > 500_000:
                known.clear()
            ids = {zlib.crc32(f.encode()) % SPACE for f in feature_strings(word)}
            known[word] = hit = tuple(i for i in ids if i in weights)
            return hit

        def score(text: str | None) -> float:
            hits: set[int] = set()
            for w in words(text):
                hit = known.get(w)
                if hit is None:
                    hit = parts(w)
                if hit:
                    hits.update(hit)
            z = self.intercept + sum(weights[i] for i in sorted(hits))
            return 0.0 if z == float("-inf") else float(1 / (1 + np.exp(-np.clip(z, -700, 700))))

        return score


NOTHING_LEARNED = Model({}, float("-inf"))


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
        chosen: np.ndarray, fairness: float = FAIRNESS) -> Model:
    """Logistic regression over the features ``chosen``, by gradient steps.

    ``pairs``: features of a text and of its swapped form. The loss adds
    ``fairness * mean((z - z_swapped)^2)`` over them.
    """
    if not len(labels):
        return NOTHING_LEARNED
    share = labels.mean()
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def packed(lists):
        ids = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)
        own = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
        keep = place[ids] >= 0
        return own[keep], place[ids[keep]]

    own, col = packed(rows)
    left, right = packed([a for a, _ in pairs]), packed([b for _, b in pairs])
    n, m, k = len(rows), len(pairs), len(chosen)
    w, b = np.zeros(k), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    speed, power = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(own, w[col], n)
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels
        grad = np.bincount(col, miss[own], k) / n + RIDGE * w
        if m:
            change = np.bincount(left[0], w[left[1]], m) - np.bincount(right[0], w[right[1]], m)
            grad += 2 * fairness / m * (np.bincount(left[1], change[left[0]], k)
                                        - np.bincount(right[1], change[right[0]], k))
        grad = np.append(grad, miss.mean())
        speed = 0.9 * speed + 0.1 * grad
        power = 0.99 * power + 0.01 * grad ** 2
        move = RATE * (speed / (1 - 0.9 ** step)) / (np.sqrt(power / (1 - 0.99 ** step)) + 1e-8)
        decay = 1 / (1 + 5 * step / STEPS)
        w, b = w - decay * move[:k], b - decay * move[k]
    return Model({int(f): float(x) for f, x in zip(chosen, w) if abs(x) > 1e-4}, float(b))


def evident(rows: DataFrame) -> DataFrame:
    """feature and evidence: how far a feature's positives are from what chance would give."""
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    counts = (rows.select("toxic", F.explode("own").alias("feature")).groupBy("feature")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
              .filter(F.col("n") >= 3))
    chance = F.col("n") * share
    return counts.select("feature", (F.abs(F.col("pos") - chance) / F.sqrt(chance + 1))
                         .alias("evidence")).filter(F.col("evidence") >= 2)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS,
          fairness: float = FAIRNESS) -> Model:
    """Fit on the ``rows`` labelled ids of lowest hash that ``learn_from`` accepts.

    The sample of ids is broadcast: its size is bounded by ``rows``. Tasks turn the sampled texts
    into hashed features, whose evidence is summed up by the engine. The driver gets the
    KEPT_FEATURES of most evidence and, per sampled row, those of its features that are among them.
    """
    sample = (labels.filter(learn_from & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            other = [swapped(f) for f in found]
            yield pd.DataFrame({
                "toxic": batch["toxic"], "own": [features(f) for f in found],
                "swap": [features(o) if o != f else None for f, o in zip(found, other)]})

    limit_batches(docs.sparkSession)
    hashed = stage(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(
        extract, "toxic int, own array<int>, swap array<int>"), "features")
    top = evident(hashed).orderBy(F.desc("evidence"), "feature").limit(KEPT_FEATURES)
    chosen = np.array(sorted(r["feature"] for r in top.collect()), np.int32)

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], **{
                c: [None if x is None else np.intersect1d(x, chosen).astype(np.int32).tobytes()
                    for x in batch[c]] for c in ("own", "swap")}})

    found = hashed.mapInPandas(shorten, "toxic int, own binary, swap binary").toPandas()
    own = [np.frombuffer(x, np.int32) for x in found["own"]]
    swap = [np.frombuffer(x, np.int32) if x is not None else None for x in found["swap"]]
    return fit(own, found["toxic"].to_numpy().astype(float),
               [(a, s) for a, s in zip(own, swap) if s is not None], chosen, fairness)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1) and predicted (1 from 0.5 on)."""
    spark = docs.sparkSession
    limit_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.intercept))  # KEPT_FEATURES at most

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Model(*shared.value).scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    kept = [F.col(c) for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
