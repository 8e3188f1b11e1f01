"""Files: JSON lines, numbering, CSV, filter documents, audits, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.constants import PRODUCT_COLUMNS, REVIEW_COLUMNS
from shelfmark.operators.keys import dense_ids
from shelfmark.operators.update import apply_filters, updated_count
from shelfmark.plans.audit import audit_files
from shelfmark.plans.tables import build_tables, clean_folder
from shelfmark.schemas import PRODUCTS, PRODUCTS_CSV, REVIEWS
from shelfmark.sources import jsonl
from shelfmark.sources.filters import read_filter_document
from shelfmark.plans.load import load_filters
from shelfmark.sources.tables import csv_delimiter, csv_headers, read_csv, read_key_column
from shelfmark.streaming.ingest import append_reviews

GOOD = {"parent_asin": "A1", "title": "T", "average_rating": 4.5, "rating_number": "7.0",
        "features": ["f", {"b": 1, "a": 2}], "description": ["d1", None, 5], "price": "$1,200.00",
        "images": [], "details": {"z": "1", "a": {"b": [1]}}, "brand": 0, "Brand": "B",
        "color": None, "Color": "red", "locale": "us"}


@pytest.fixture
def dump(tmp_path):
    lines = [json.dumps(GOOD), "", "   ", "{bad", '{"parent_asin":"X"} trailing',
             '{"parent_asin":"X"}{"parent_asin":"Y"}', "[1]", "5",
             '{"parent_asin":"A2","parent_asin":"A3","features":"[1]","description":"{x","price":3}']
    (tmp_path / "meta_a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "meta_b.jsonl").write_text('{"parent_asin":"A4","details":"plain"}\n')
    review = {"parent_asin": "A1", "rating": "5", "title": "good", "text": "line\n\"quoted\", é",
              "timestamp": 1588687728, "helpful_vote": 0, "verified_purchase": False,
              "user": "u1"}
    other = {"parent_asin": "A1", "timestamp": "1588687728", "helpful_vote": 0, "helpful": 3,
             "verified": "yes"}
    (tmp_path / "a.jsonl").write_text(json.dumps(review) + "\n" + json.dumps(other) + "\n{")
    return str(tmp_path)


def test_clean_folder(spark, dump):
    cleaned = clean_folder(spark, dump)
    rows = {r.product_id: r for r in cleaned.products.collect()}
    assert [rows[i].parent_asin for i in sorted(rows)] == ["A1", "A3", "A4"]
    first = rows[0]
    assert (first.rating_number, first.average_rating, first.price) == (7, 4.5, 1200.0)
    assert (first.brand, first.color, first.product_locale) == ("B", "red", "us")
    assert first.product_description == "d1\n5"
    assert first.features_json == '["f",{"b":1,"a":2}]' and first.images_json == "[]"
    assert list(json.loads(first.details_json)) == ["z", "a"]
    assert rows[1].features_json == '"[1]"' and rows[1].product_description == "{x"
    assert rows[1].price == 3.0 and rows[2].details_json == '"plain"'
    assert cleaned.rejects.count() == 6
    reviews = cleaned.reviews.orderBy(F.col("review_ts").asc_nulls_last()).collect()
    assert str(reviews[0].review_ts) == "2020-05-05 14:08:48"
    assert (reviews[0].helpful_vote, reviews[0].verified_purchase, reviews[0].user_id) == (0, 0, "u1")
    assert (reviews[1].review_ts, reviews[1].helpful_vote, reviews[1].verified_purchase) == \
        (None, 0, 1)


def test_compat(spark, dump):
    rows = clean_folder(spark, dump, compat=True).reviews.collect()
    assert sorted((r.helpful_vote, r.verified_purchase) for r in rows if r.helpful_vote) == [(3, 1)]
    assert [r.verified_purchase for r in rows if r.helpful_vote is None] == [None]


def test_build_and_reload_csv(spark, dump, tmp_path):
    out = str(tmp_path / "out")
    tables = build_tables(spark, dump, out, csv=True)
    assert tables.products.schema == PRODUCTS and tables.reviews.schema == REVIEWS
    products = read_csv(spark, f"{out}/products_csv", PRODUCTS_CSV)
    assert products.columns == PRODUCT_COLUMNS
    assert sorted(map(tuple, products.collect()), key=str) == \
        sorted((tuple(r)[:18] for r in tables.products.collect()), key=str)
    reviews = read_csv(spark, f"{out}/reviews_csv", REVIEWS)
    assert reviews.columns == REVIEW_COLUMNS
    assert "line\n\"quoted\", é" in [r.review_text for r in reviews.collect()]


def test_dense_ids_do_not_depend_on_layout(spark, tmp_path):
    random.seed(3)
    expected, n = [], 0
    for name in ("a", "b", "c"):
        lines = []
        for _ in range(400):
            if random.random() < 0.1:
                lines.append("{broken")
            else:
                lines.append(json.dumps({"k": f"{name}{n}", "pad": "x" * random.randint(1, 80)}))
                expected.append(f"{name}{n}")
                n += 1
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    keys = jsonl.Keys(plain=("k",))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2048", "9000", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            records = jsonl.valid_records(jsonl.parse_lines(
                jsonl.read_lines(spark, str(tmp_path)), keys))
            rows = records.select(*jsonl.POSITION, jsonl.record_of(keys).text("k").alias("k"))
            got = dense_ids(rows, "id").collect()
            assert {r.id: r.k for r in got} == dict(enumerate(expected))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_filter_document_and_update(spark, tmp_path):
    entries = [{"product_id": 1, "filters": [{"a": 1}]}, {"product_id": "2", "filters": []},
               {"product_id": 1, "filters": [{"a": 2}]}, {"product_id": 9, "filters": [3]},
               {"product_id": 3}, {"product_id": "x", "filters": [4]}, {"filters": [5]}]
    whole, lines = tmp_path / "f.json", tmp_path / "f.jsonl"
    whole.write_text(json.dumps(entries, indent=2))
    lines.write_text("\n".join(map(json.dumps, entries)))
    products = spark.createDataFrame([(1, None), (2, None), (3, "old")],
                                     "product_id long, filters_json string")
    for source in (read_filter_document(spark, str(whole)),
                   read_filter_document(spark, str(lines), lines=True)):
        updated = apply_filters(products, source)
        want = {1: '[{"a":2}]', 2: "[]", 3: "old"}
        assert {r[0]: r[1] for r in updated.collect()} == want
        assert {r[0]: r[1] for r in apply_filters(updated, source).collect()} == want
        assert updated_count(products, source) == 2
    products.write.parquet(str(tmp_path / "products"))
    for source, by_line in ((whole, False), (lines, True)):
        loaded = load_filters(spark, str(source), str(tmp_path / "products"),
                              str(tmp_path / f"loaded-{by_line}"), by_line)
        assert (loaded.updated, loaded.unknown, loaded.rejected) == (2, 1, 3)
        assert {r[0]: r[1] for r in loaded.table.collect()} == want
    single = tmp_path / "one.json"
    single.write_text('{"product_id": 1, "filters": []}')
    with pytest.raises(ValueError):
        read_filter_document(spark, str(single))


def test_audit_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;t\nk1;x\nk1;"y\nz"\n k2 ;z\n;w\n')
    (tmp_path / "b.csv").write_text("id,t\nk1,x\nk3,y\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert csv_delimiter(spark, paths[0]) == ";"
    found = audit_files(spark, paths, key="id", report=str(tmp_path / "report"))
    assert found.summary.first().asDict() == {
        "files": 2, "total_rows": 6, "unique_keys": 3, "cross_file_keys": 1,
        "within_file_keys": 1}
    assert {tuple(r) for r in found.files.collect()} == {("a.csv", 3, 1, 1), ("b.csv", 2, 0, 0)}
    assert {tuple(r) for r in found.report.collect()} == {
        ("cross_file", "k1", "a.csv;b.csv", "a.csv:2;b.csv:1"),
        ("within_file", "k1", "a.csv", "2")}
    with pytest.raises(ValueError):
        read_key_column(spark, paths[0], "nope", require_key=True)
    assert read_key_column(spark, paths[0], "nope").filter("key IS NOT NULL").count() == 0


def test_audit_by_path_and_first_seen(spark, tmp_path):
    for folder, rows in (("a", "z9,1\nk1,2\n"), ("b b", "k1,3\nz9,4\n"), ("c", "q,5\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p.csv").write_text('id,"t;;;;u"\n' + rows)
    paths = [str(tmp_path / f / "p.csv") for f in ("a", "b b", "c")]
    found = audit_files(spark, paths, key="id")
    assert found.summary.first().asDict() == {
        "files": 3, "total_rows": 5, "unique_keys": 3, "cross_file_keys": 2,
        "within_file_keys": 0}
    assert [tuple(r) for r in found.examples.collect()] == [
        ("z9", 2, 2, "p.csv;p.csv", "p.csv:1;p.csv:1"),
        ("k1", 2, 2, "p.csv;p.csv", "p.csv:1;p.csv:1")]
    assert [r["file"] for r in found.files.collect()] == ["p.csv"] * 3
    assert len(csv_headers(spark, paths)) == 1   # one scan for all three


def test_stream_equals_batch(spark, dump, tmp_path):
    table = str(tmp_path / "stream")
    for _ in range(2):   # the second run finds nothing new
        append_reviews(spark, dump, table, str(tmp_path / "state")).awaitTermination()
    batch = clean_folder(spark, dump).reviews
    assert sorted(map(str, spark.read.parquet(table).collect())) == \
        sorted(map(str, batch.collect()))


def test_csv_keeps_outer_white_space(spark, tmp_path):
    from shelfmark.sources.tables import read_csv, write_csv
    cells = ["  lead", "tail  ", "\tTab", "a\n"]
    rows = spark.createDataFrame([(c,) for c in cells], "text string")
    write_csv(rows, str(tmp_path / "padded"))
    assert sorted(r.text for r in read_csv(spark, str(tmp_path / "padded"), rows.schema)
                  .collect()) == sorted(cells)
