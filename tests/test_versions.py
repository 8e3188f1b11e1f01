"""Versioned tables: what readers see after updates, failures and two writers at once."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.load import load_version
from shelfmark.sources import versions


def table(spark, n=400):
    return spark.range(n).select(F.col("id").alias("product_id"), F.lit(None).cast("string")
                                 .alias("filters_json"), F.lit("x").alias("other"))


def document(tmp_path, name, entries):
    (tmp_path / name).write_text(json.dumps(entries, indent=1))
    return str(tmp_path / name)


def test_two_loads(spark, tmp_path):
    root = str(tmp_path / "table")
    versions.create_table(table(spark), root, "product_id")
    first = load_version(spark, document(tmp_path, "a.json", [
        {"product_id": 3, "filters": [1]}, {"product_id": 3, "filters": [2]},
        {"product_id": 9999, "filters": []}, {"product_id": "?"}, 5]), root)
    assert (first.updated, first.unknown, first.rejected) == (1, 1, 1)
    load_version(spark, document(tmp_path, "b.json", [{"product_id": 399, "filters": []}]), root)
    assert versions.history(spark, root) == [1, 2, 3]
    now = {r.product_id: r.filters_json for r in versions.read_version(spark, root).collect()}
    assert len(now) == 400 and {k: v for k, v in now.items() if v} == {3: "[2]", 399: "[]"}
    old = {r.filters_json for r in versions.read_version(spark, root, 1).collect()}
    assert old == {None}


def test_only_touched_files_are_written(spark, tmp_path):
    root = str(tmp_path / "table")
    before = set(versions.create_table(table(spark), root, "product_id", 4).inputFiles())
    assert len(before) > 2
    keys = spark.createDataFrame([(3,), (4,)], "product_id bigint")
    after = versions.update_table(spark, root, keys, "product_id",
                                  lambda rows: rows.withColumn("other", F.lit("y")))
    assert len(set(after.inputFiles()) & before) == len(before) - 1
    none = spark.createDataFrame([(-1,)], "product_id bigint")
    versions.update_table(spark, root, none, "product_id", lambda rows: 1 / 0)
    assert versions.history(spark, root) == [1, 2]


def test_a_failed_load_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    versions.create_table(table(spark), root, "product_id")
    path = document(tmp_path, "a.json", [{"product_id": 3, "filters": [1]}])

    def broken(rows):
        return rows.withColumn("other", F.raise_error(F.lit("lost")).cast("string"))
    keys = spark.createDataFrame([(3,)], "product_id bigint")
    with pytest.raises(Exception, match="lost"):
        versions.update_table(spark, root, keys, "product_id", broken)
    with monkeypatch.context() as m:  # the data is written, the commit is not
        m.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            load_version(spark, path, root)
    assert versions.history(spark, root) == [1]
    assert versions.read_version(spark, root).filter("filters_json IS NOT NULL").count() == 0
    assert load_version(spark, path, root).table.filter("filters_json = '[1]'").count() == 1


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "table")
    versions.create_table(table(spark, 20), root, "product_id")
    keys = spark.createDataFrame([(3,)], "product_id bigint")

    def change(rows):
        # another writer commits while this one is at work
        schema, files = versions._files(spark, root, 1)
        versions._publish(spark, root, 2, schema, files)
        return rows
    with pytest.raises(versions.Conflict):
        versions.update_table(spark, root, keys, "product_id", change)
    assert versions.history(spark, root) == [1, 2]
    with pytest.raises(versions.Conflict):
        versions.create_table(table(spark, 3), root, "product_id")
    with pytest.raises(ValueError):
        versions.read_version(spark, root, 7)
    assert versions.create_table(table(spark, 0), str(tmp_path / "none"), "product_id").count() == 0
