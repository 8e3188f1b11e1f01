"""Forms for large inputs against the small ones: languages without a shuffle, any k per key."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import language
from shelfmark.operators.embedding import top_reviews


def test_languages_in_place_and_by_join(spark, monkeypatch):
    r = random.Random(3)
    samples = spark.createDataFrame([(c, " ".join("".join(r.choices(letters, k=r.randint(1, 6)))
                                                  for _ in range(300)))
                                     for c, letters in (("en", "abcde"), ("de", "cdefü"), ("zz", "xyz😀"))],
                                    "lang string, text string")
    profiles = language.train_profiles(samples).cache()
    texts = [" ".join("".join(r.choices("abcdefüxyzq", k=r.randint(1, 7))) for _ in range(r.randint(0, 9)))
             for _ in range(400)] + [None, "", "123 !", "qqq", "ЖЖ", "a A a", "😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    here = {x.id: x.lang for x in language.detect_language(df, profiles, "id", "q").collect()}
    flags = {x.id: x.is_english for x in language.with_english(df, "id", "q", profiles).collect()}
    plan = language.with_english(df, "id", "q", profiles)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(language, "PROFILE_ROWS", 0)
    joined = {x.id: x.lang for x in language.detect_language(df, profiles, "id", "q").collect()}
    assert here == joined and len(set(here.values())) == 3
    assert flags == {x.id: x.is_english for x in language.with_english(df, "id", "q", profiles).collect()}
    monkeypatch.setattr(language, "PROFILE_ROWS", 10)
    assert language.language_of(profiles.limit(0), "q") is not None
    assert language.detect_language(df, profiles.limit(0), "id", "q").count() == 0


def test_top_reviews_of_any_k(spark):
    rows = spark.range(14_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("parent_asin"),
        (F.col("id") * 7919 % 5003).alias("helpful_vote"), F.col("id").alias("n")).repartition(5)
    ties = [F.col("n")]
    assert int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")) < 5000
    got = top_reviews(rows, 5000, ties=ties)
    assert got.columns == ["parent_asin", "helpful_vote", "n", "rank"]
    by = {}
    for x in rows.collect():
        by.setdefault(x.parent_asin, []).append((-x.helpful_vote, x.n))
    want = {(k, i + 1, n) for k, v in by.items() for i, (_, n) in enumerate(sorted(v)[:5000])}
    assert {(x.parent_asin, x.rank, x.n) for x in got.collect()} == want
    assert got.filter("parent_asin = 'hot'").count() == 5000


def test_compaction_writes_nothing_of_mixed_lengths(spark, tmp_path):
    import pytest
    from shelfmark.sources.tables import compact_shards
    rows = spark.createDataFrame([(3, [1.0, 2.0]), (1, [3.0]), (2, [4.0, 5.0])], "k int, vector array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="differ"):
        compact_shards(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1)
    assert not (tmp_path / "out").exists()
    rows.filter("k > 1").write.parquet(str(tmp_path / "same"))
    whole = compact_shards(spark, str(tmp_path / "same"), str(tmp_path / "out"), 1, key="k")
    assert [r.k for r in whole.collect()] == [2, 3]
