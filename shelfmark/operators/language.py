"""English test for queries.

A language profile gives each group of one to three characters of a word, its ends included, an
integer weight: its scaled log share in the language. A text belongs to the language with the largest
weight sum. Integer sums do not depend on the order of rows, so the outcome is repeatable.

Profiles are small beside the texts. Up to PROFILE_ROWS weights they go to the tasks as one table of
numbers, and a text is scored where it is read: each distinct word of a batch once. Larger ones are
joined with the groups of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from shelfmark.operators.samples import LANGUAGE_SAMPLES

#: Weights that the tasks get as a table, at most: 16 bytes each for every language, and the groups.
PROFILE_ROWS = 400_000

#: Words whose sums a task remembers.
WORDS_KEPT = 100_000

WEIGHT_SCALE = 1000
MISSING_WEIGHT = -14 * WEIGHT_SCALE


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def char_grams(chars: Column) -> Column:
    """All groups of 1 to 3 neighbours in an array of characters, the lone space left out."""
    size = F.size(chars)
    join = lambda a, b: F.concat(a, b)
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), size), join)
    triples = F.zip_with(pairs, F.slice(chars, F.lit(3), size), join)
    return F.filter(F.concat(chars, pairs, triples), lambda g: g.isNotNull() & (g != " "))


def _cut(word_rows: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep..., gram)`` from ``(keep..., word)``; a space marks both ends of the word."""
    return (word_rows.select(*keep, F.split(F.concat(F.lit(" "), F.col("word"), F.lit(" ")), "")
                             .alias("chars"))
            .select(*keep, F.explode(char_grams(F.col("chars"))).alias("gram")))


def train_profiles(samples: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, weight)`` from labelled texts: all groups of each language."""
    # Words repeat much more than texts do, so they are counted before they are cut up.
    counted = (samples.select(F.col(lang).alias("lang"), F.explode(words(F.col(text)))
                              .alias("word"))
               .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    counts = _cut(counted, ["lang", "n"]).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    weight = F.round(F.log(F.col("n") / F.col("total")) * WEIGHT_SCALE).cast("bigint")
    return counts.join(totals, "lang").select("lang", "gram", weight.alias("weight"))


def default_profiles(spark: SparkSession) -> DataFrame:
    """Profiles from the sample texts that come with the package."""
    samples = spark.createDataFrame(list(LANGUAGE_SAMPLES.items()), "lang string, text string")
    return train_profiles(samples)


class _Profile:
    """Gains over MISSING_WEIGHT per group and language, and which groups a language holds."""

    def __init__(self, weights: pa.Table):
        rows = weights.to_pydict()
        self.langs = sorted(set(rows["lang"]))
        self.places = {g: i for i, g in enumerate(dict.fromkeys(rows["gram"]))}
        self.gains = np.zeros((len(self.places) + 1, 2 * len(self.langs)), np.int64)
        column = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, weight in zip(rows["lang"], rows["gram"], rows["weight"]):
            self.gains[self.places[gram], column[lang]] = weight - MISSING_WEIGHT
            self.gains[self.places[gram], len(self.langs) + column[lang]] = 1

    def word(self, word: str) -> np.ndarray:
        """Sums over the groups of a word: gains, then how many groups a language holds."""
        chars = f" {word} "
        grams = [*word, *(chars[i:i + 2] for i in range(len(chars) - 1)),
                 *(chars[i:i + 3] for i in range(len(chars) - 2))]
        return self.gains[[self.places.get(g, -1) for g in grams]].sum(axis=0)

    def languages(self, texts: pa.Array, known: dict[str, np.ndarray]) -> pa.Array:
        n, listed = len(self.langs), []
        if not n:
            return pa.nulls(len(texts), pa.string())
        coded = texts.flatten().dictionary_encode()
        for w in coded.dictionary.to_pylist():
            found = known.get(w)
            if found is None:
                found = self.word(w)
                if len(known) < WORDS_KEPT:
                    known[w] = found
            listed.append(found)
        sums = np.array(listed, np.int64).reshape(len(listed), 2 * n)
        at = coded.indices.to_numpy()
        ends = np.cumsum(texts.value_lengths().fill_null(0).to_numpy())
        upto = np.concatenate([[0], ends])
        total = np.stack([np.diff(np.concatenate([[0], np.cumsum(sums[at, c])])[upto])
                          for c in range(2 * n)], axis=1)
        score, holds = total[:, :n], total[:, n:] > 0
        best = np.where(holds, score, np.iinfo(np.int64).min).argmax(axis=1)
        names = np.array(self.langs, object)[best]
        return pa.array(names, pa.string(), mask=~holds.any(axis=1))


def language_of(profiles: DataFrame, text: str) -> Column | None:
    """The language of a text column as a column, NULL without a known group; None if the profiles
    are too large for the tasks."""
    if profiles.count() > PROFILE_ROWS:
        return None
    profile = _Profile(profiles.select("lang", "gram", "weight").toArrow())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            yield profile.languages(batch, known)
    return F.arrow_udf(run, StringType())(F.coalesce(words(F.col(text)), F.array().cast("array<string>")))


def detect_language(df: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, lang)`` for every text with a group that some profile holds; ties go to the first
    language code. A group that a profile does not hold costs MISSING_WEIGHT."""
    found = language_of(profiles, text)
    if found is not None:
        return df.select(key, found.alias("lang")).filter(F.col("lang").isNotNull())
    return _detect_by_join(df, profiles, key, text)


def _detect_by_join(df: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """The same for profiles of any size. Groups are counted per text before they meet them."""
    # One row per group with the weights of all languages, so that a group joins once.
    per_gram = profiles.groupBy("gram").agg(
        F.collect_list(F.struct("lang", F.col("weight") - MISSING_WEIGHT)).alias("gains"))
    # The same penalty for every group cancels out, so only the gain over it is summed.
    word_rows = df.select(key, F.explode(words(F.col(text))).alias("word"))
    counted = _cut(word_rows, [key]).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    gains = (counted.join(per_gram, "gram")
             .select(key, "n", F.inline("gains").alias("lang", "gain"))
             .groupBy(key, "lang").agg(F.sum(F.col("gain") * F.col("n")).alias("score")))
    best = gains.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("rank"), "lang"))
                                  .alias("best"))
    return best.select(key, "best.lang")


def with_english(df: DataFrame, key: str, text: str, profiles: DataFrame | None = None,
                 flag: str = "is_english") -> DataFrame:
    """Add the flag; blank texts and texts without letters are not English.

    ``key`` is unique. Equal texts may be scored once by passing distinct texts.
    """
    profiles = default_profiles(df.sparkSession) if profiles is None else profiles
    found = language_of(profiles, text)
    if found is not None:
        return df.withColumn(flag, F.coalesce(found == "en", F.lit(False)))
    found = _detect_by_join(df, profiles, key, text).withColumnRenamed("lang", "detected")
    return df.join(found, key, "left").withColumn(
        flag, F.coalesce(F.col("detected") == "en", F.lit(False))).drop("detected")
