"""Query selection, profiles, paging, and the plans behind them."""

from pyspark.sql import functions as F

from shelfmark.operators import selection as sel
from shelfmark.operators.profile import fill_rates
from shelfmark.plans.filters import build_filters
from shelfmark.plans.queries import build_queries, select_queries
from shelfmark.schemas import JUDGED_QUERIES

SF = "/root/testdata/sf0.001"


def judged(spark):
    rows = [("1", "red lamp for the living room", "q1", "K1", "us", "E", 1, 1, "train"),
            ("2", "lampe für das wohnzimmer und die küche", "q2", "K1", "de", "E", 1, 1, "train"),
            ("3", "garden chair with cushion", "q3", "K9", "us", "S", 1, 1, "train"),
            ("4", "red lamp for the living room", "q1", "K2", "us", "I", 0, 1, "test"),
            ("5", "red lamp for the living room", "q1", "K2", "us", "I", 1, 1, "test"),
            ("6", None, "q4", "K2", "us", "I", 1, 1, "test"),
            ("7", "table", "q5", None, "us", "I", 1, 1, "test")]
    return spark.createDataFrame(rows, JUDGED_QUERIES)


def catalogue(spark):
    return spark.createDataFrame(
        [(0, "K1", "Home", "Red Lamp", '["a"]'), (1, "K2", "Home", "Lamp", '["b"]'),
         (2, "", "Home", "x", None), (3, None, "Home", "y", None)],
        "product_id long, parent_asin string, main_category string, product_title string, "
        "features_json string")


def test_select_queries(spark):
    kept = select_queries(judged(spark), catalogue(spark))
    assert sorted(r.example_id for r in kept.collect()) == ["1", "5"]
    assert kept.columns == JUDGED_QUERIES.fieldNames()


def test_build_queries_reports_steps(spark, tmp_path):
    steps = build_queries(judged(spark), catalogue(spark), str(tmp_path / "q")).orderBy("step")
    assert [(r.before, r.after, r.removed) for r in steps.collect()] == [(6, 4, 2), (4, 2, 2)]


def test_build_filters_writes_documents(spark, tmp_path):
    kinds = {"main_category": "exact_match", "product_title": "NER_contains",
             "features_json": "json_contains"}
    sets = build_filters(catalogue(spark), judged(spark), str(tmp_path), kinds=kinds)
    back = spark.read.json(str(tmp_path / "filters_deduplicated")).orderBy("product_id").collect()
    assert [r.product_id for r in back] == [0, 1]
    first = back[0].filters[0]
    assert (first.filter_column, first.filter_value, first.match_count, first.total_in_db) == \
        ("main_category", "Home", 4, 4)
    assert sets.bands.count() == 2


def test_subset_reaches_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = sel.subset(rows, "l_linenumber", 1).select("l_orderkey")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "EqualTo(l_linenumber,1)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_page(spark):
    rows = spark.range(100).withColumnRenamed("id", "product_id").repartition(7)
    assert [r[0] for r in sel.page(rows, 20, 5).collect()] == [20, 21, 22, 23, 24]
    plan = sel.page(rows, 20, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_fill_rates(spark):
    rows = spark.createDataFrame([("a", 1.0), ("[]", float("nan")), (None, 2.0)],
                                 "s string, d double")
    got = {r.column: (r.filled, r.percentage) for r in fill_rates(rows).collect()}
    assert got == {"s": (1, 33.33), "d": (2, 66.67)}


def test_step_report_is_one_pass(spark):
    rows = spark.range(10).select((F.col("id") < 6).alias("a"), (F.col("id") > 2).alias("b"))
    got = [tuple(r) for r in sel.step_report(rows, ["a", "b"]).orderBy("step").collect()]
    assert got == [(1, "a", 10, 6, 4), (2, "b", 6, 3, 3)]
    assert [tuple(r) for r in sel.keep_flagged(rows.withColumn("x", F.lit(1)), ["a", "b"])
            .collect()] == [(1,)] * 3
