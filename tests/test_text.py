"""Phrase search, text filters and the language test."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import padded, tokens
from shelfmark.operators import filters as flt
from shelfmark.operators.language import train_profiles, with_english
from shelfmark.operators.phrases import (describe_phrases, match_ids, phrase_counts,
                                         phrase_matches, search_bodies)


def phrase_frame(spark, pairs):
    return spark.createDataFrame(pairs, "field string, raw string").select(
        "field", "raw", padded(tokens(F.col("raw"))).alias("phrase"))


def test_golden_phrases(spark):
    rows = spark.createDataFrame([
        (1, '["Café-Noir blue, steel"]', '{"Item Weight": "3 oz"}'),
        (2, "blue steel cafe noir", ""), (3, "steel blue", None)], "id long, f string, g string")
    bodies = search_bodies(rows, "id", ["f", "g"])
    asked = phrase_frame(spark, [("f", "blue steel"), ("f", "CAFE noir"), ("f", "steel"),
                                 ("f", "blu"), ("f", "!!!"), ("f", ""), ("g", "weight 3"),
                                 ("f", "noir blue steel"), ("f", "weight 3")])
    found = phrase_matches(bodies, asked.select("field", "phrase").distinct())
    got = {}
    for r in found.join(asked, ["field", "phrase"]).collect():
        got.setdefault((r.field, r.raw), set()).add(r.row_id)
    assert got == {("f", "blue steel"): {1, 2}, ("f", "CAFE noir"): {1, 2},
                   ("f", "steel"): {1, 2, 3}, ("g", "weight 3"): {1},
                   ("f", "noir blue steel"): {1}}


def test_phrases_against_direct(spark):
    random.seed(8)
    words = ["a", "b", "c", "dd", "e"]
    docs = [(i, " ".join(random.choices(words, [20, 5, 5, 2, 1], k=random.randint(1, 12))))
            for i in range(150)]
    phrases = {" ".join(p) for n in (1, 2, 3, 4) for p in itertools.product(words[:4], repeat=n)
               if random.random() < 0.4}
    bodies = search_bodies(spark.createDataFrame(docs, "id long, f string"), "id", ["f"])
    asked = phrase_frame(spark, [("f", p) for p in phrases]).drop("raw")
    want = {(p, i) for p in phrases for i, d in docs if f" {p} " in f" {d} "}
    got = {(r.phrase.strip(), r.row_id)
           for r in phrase_matches(bodies, asked).collect()}
    assert got == want
    counts = {r.phrase.strip(): r.match_count
              for r in phrase_counts(bodies, asked).collect()}
    assert counts == {p: sum(1 for q, _ in want if q == p) for p, _ in want}


def test_long_phrases_and_plans(spark):
    """Whole documents as phrases, repeated tokens, and no text in a shuffle of the matching."""
    random.seed(9)
    docs = [(i, " ".join(random.choices("ab", k=random.randint(1, 200)))) for i in range(60)]
    docs += [(100, docs[0][1] + " " + docs[1][1]), (101, "a " * 90), (102, "a " * 77)]
    bodies = search_bodies(spark.createDataFrame(docs, "id long, f string"), "id", ["f"])
    asked = phrase_frame(spark, [("f", d) for d in sorted({d for _, d in docs})]).drop("raw")
    want = {(p.strip(), i) for _, p in docs for i, d in docs if f" {p.strip()} " in f" {d.strip()} "}
    got = {(r.phrase.strip(), r.row_id) for r in phrase_matches(bodies, asked).collect()}
    assert got == want
    plan = match_ids(bodies, describe_phrases(asked))._jdf.queryExecution().executedPlan().toString()
    assert "phrase_id" in plan and "body" not in plan and "phrase#" not in plan
    none = asked.filter("phrase = ''")
    assert phrase_matches(bodies, none).count() == phrase_counts(bodies, none).count() == 0
    assert phrase_matches(bodies.limit(0), asked).count() == 0


def catalogue(spark):
    """Rows 1 and 2 share a key; the value of row 1 is behind an escaped line break in its own
    JSON text, but in plain sight in row 2."""
    rows = [(1, "K", "Big Red Lamp", '["old\\nLamp"]'), (2, "K", "plain lamp", '["Lamp oil"]'),
            (3, "M", "Big Red Chair", '["old\\nChair"]'), (4, None, "Big Red Lamp", '["Lamp"]')]
    return spark.createDataFrame(
        rows, "product_id long, parent_asin string, product_title string, features_json string")


def test_text_filters_own_key(spark):
    products = catalogue(spark)
    interest = products.filter(F.col("parent_asin").isNotNull())
    kinds = {"product_title": "NER_contains", "features_json": "json_contains"}
    found = flt.text_filters(products, interest, 4, kinds)
    got = {(r.product_id, r.filter_column, r.value, r.match_count, r.match_percentage)
           for r in found.collect()}
    assert got == {
        (1, "product_title", "Big Red Lamp", 1, 25.0),   # row 4 has no key: not in the index
        (2, "product_title", "plain lamp", 1, 25.0),
        (3, "product_title", "Big Red Chair", 1, 25.0),
        (1, "features_json", "Lamp", 1, 25.0),           # held by row 2 of the same key
        (2, "features_json", "Lamp", 1, 25.0)}           # "Chair" of row 3 is found nowhere


def test_filter_lists_and_order(spark):
    rows = [(i, f"K{i}", "Home" if i % 2 else "home", f"item {i}", "S", 4.0 + i % 2, i, 9.5 + i,
             '["x"]', '{"a":"y"}') for i in range(10)]
    products = spark.createDataFrame(
        rows, "product_id long, parent_asin string, main_category string, product_title string, "
              "store string, average_rating double, rating_number long, price double, "
              "features_json string, details_json string")
    every = flt.all_filters(products, products).cache()
    listed = flt.filter_lists(products, flt.unique_filters(every)).collect()
    order = list(flt.FILTER_KINDS)
    for row in listed:
        places = [order.index(f.filter_column) for f in row.filters]
        assert places == sorted(places)
        keys = [(f.filter_column, f.match_count, f.match_percentage) for f in row.filters]
        assert len(keys) == len(set(keys))
        category = row.filters[0]
        assert (category.value, category.match_count) == (row.main_category, 10)
    assert every.count() > sum(len(r.filters) for r in listed)


def test_percentage_matches_decimal_rounding(spark):
    total = 64
    rows = spark.range(1, total + 1).select("id", flt.percentage(F.col("id"), total).alias("p"))
    assert all(r.p == round(r.id / total * 100, 3) for r in rows.collect())


def test_default_language_profiles(spark):
    texts = [("wireless headphones for running with long battery life", True),
             ("stainless steel water bottle for children", True),
             ("kabellose kopfhörer mit langer akkulaufzeit für den sport", False),
             ("botella de agua de acero para los niños y la escuela", False),
             ("bouteille en acier pour les enfants et pour l'école", False),
             ("", False), ("12345 !!", False), (None, False)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, q string")
    got = {r.id: r.is_english for r in with_english(rows, "id", "q").collect()}
    assert got == {i: e for i, (_, e) in enumerate(texts)}


def test_trained_profiles_on_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    unseen = F.col("doc_id") >= 100
    profiles = train_profiles(docs.filter(~unseen)).cache()
    judged = with_english(docs.filter(unseen), "doc_id", "text", profiles)
    right = judged.filter(F.col("is_english") == (F.col("lang") == "en")).count()
    assert right >= 0.95 * judged.count()


def test_phrases_around_the_exact_length(spark, monkeypatch):
    """Lengths where one window turns into two, repeats of a window in a row, no filter at all."""
    from shelfmark.operators import phrases
    random.seed(10)
    lengths = [1, 2, 3, 15, 16, 17, 18, 31, 32, 33, 34, 63, 64, 65, 129]
    docs = [(i, " ".join(random.choices("abc", k=240))) for i in range(12)] + [(50, "a " * 140)]
    asked = {" ".join(d.split()[s:s + n]) for n in lengths for _, d in docs for s in (0, 3, 100)}
    asked |= {" ".join("a" * n) for n in lengths}
    want = {(p, i) for p in asked for i, d in docs if f" {p} " in f" {' '.join(d.split())} "}
    bodies = search_bodies(spark.createDataFrame(docs, "id long, f string"), "id", ["f"])
    frame = phrase_frame(spark, [("f", p) for p in sorted(asked)]).drop("raw")
    for step, bits in ((1 << 20, 27), (50, 27), (1 << 20, 4)):
        monkeypatch.setattr(phrases, "STEP_TOKENS", step)
        monkeypatch.setattr(phrases, "LEAST_BITS", min(bits, 16))
        monkeypatch.setattr(phrases, "FILTER_BITS", bits)
        got = {(r.phrase.strip(), r.row_id) for r in phrase_matches(bodies, frame).collect()}
        assert got == want
        counts = {r.phrase.strip(): r.match_count for r in phrase_counts(bodies, frame).collect()}
        assert counts == {p: sum(q == p for q, _ in want) for p, _ in want}


def test_candidates_stay_near_the_matches(spark):
    """Places that are looked up, against places that match, on common words."""
    from shelfmark.operators import phrases
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bodies = search_bodies(docs, "doc_id", ["text"])
    words = F.split(F.trim("body"), " ")
    asked = bodies.filter(F.size(words) > 60).select(
        "field", F.explode(F.array(*[F.concat(F.lit(" "), F.array_join(F.slice(words, at, n), " "), F.lit(" "))
                                     for at, n in ((1, 2), (5, 3), (9, 5), (20, 7), (30, 20))]))
        .alias("phrase")).distinct()
    described = phrases.describe_phrases(asked)
    index = phrases.window_index(bodies, described)
    anchors = phrases.phrase_anchors(index, described)
    tried = anchors.agg(F.sum("documents")).first()[0]
    assert tried <= 2 * phrases.ids_in(index, anchors).count()


def test_text_filters_move_totals(spark, monkeypatch):
    """A phrase that every text holds is one row per step of texts, not one per text; long phrases
    and those of another row of the same key are found beside it."""
    from shelfmark.operators import phrases
    long = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"K{i}", "Big Lamp", '["Big Lamp"]') for i in range(300)]
    rows += [(900, "M", long, '["x\\nRare Thing"]'), (901, "M", f"a {long} b", '["Rare Thing"]'),
             (902, "N", "plain", '["x\\nRare Thing"]')]
    products = spark.createDataFrame(
        rows, "product_id long, parent_asin string, product_title string, features_json string")
    written, stage = {}, phrases.stage

    def counted(df, label, *options, **more):
        out = stage(df, label, *options, **more)
        written[label] = max(out.count(), written.get(label, 0))
        return out

    monkeypatch.setattr(phrases, "stage", counted)
    kinds = {"product_title": "NER_contains", "features_json": "json_contains"}
    found = flt.text_filters(products, products, len(rows), kinds)
    got = {(r.product_id, r.filter_column, r.value, r.match_count) for r in found.collect()}
    want = {(i, c, "Big Lamp", 300) for i in range(300) for c in kinds}
    want |= {(900, "product_title", long, 2), (901, "product_title", f"a {long} b", 1),
             (902, "product_title", "plain", 1), (900, "features_json", "Rare Thing", 1),
             (901, "features_json", "Rare Thing", 1)}
    assert got == want
    assert max(written.values()) < 100
