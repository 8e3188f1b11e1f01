"""Repeated ids, empty tables and many files: vectors and token records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import crosspolytope, records
from shelfmark.llm.catalog import tokenizer
from shelfmark.session import new_folder
from tests.llm.helpers import documents

VEC = "vec_id bigint, embedding array<double>, label int"


def found(spark, rows):
    out = crosspolytope.near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    return sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in out)


def test_vectors_with_repeated_ids(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=16)
    a, b, c = ((base + r.normal(size=16) * 0.02).tolist() for _ in range(3))
    assert found(spark, [(1, a, 0), (1, b, 1), (2, c, 1)]) == [
        (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert found(spark, [(1, a, 0), (1, b, 0), (2, c, 0)]) == [
        (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    # equal rows, and the same vector under other ids and labels
    assert found(spark, [(4, a, 0), (4, a, 0), (3, a, 0), (9, a, 1)]) == [
        (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (9, 0, 9, True)]


def test_vectors_that_link_with_nothing(spark):
    rows = [(i, None, 0) for i in range(50)] + [(1, [0.0] * 4, 0), (None, [1.0] * 4, 0),
                                               (7, [1.0] * 4, None), (8, [1.0] * 4, 0)]
    got = crosspolytope.near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    assert len(got) == 54 and all(x.n_links == 0 and x.kept for x in got)
    assert all(x.component_id == x.vec_id for x in got)
    assert crosspolytope.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_vectors_recall_at_the_threshold(spark):
    """Pairs of 64 dimensions at cosine 0.9301, just above the threshold."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(600):
        x, y = r.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        z = 0.9301 * x + np.sqrt(1 - 0.9301 ** 2) * y / np.linalg.norm(y)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, z.tolist(), 0)]
    got = crosspolytope.near_duplicates(spark.createDataFrame(rows, VEC)).filter("n_links > 0")
    assert got.count() >= 0.98 * len(rows)


def test_records_of_null_ids_repeats_and_other_columns(spark):
    rows = [(None, "no id", 1), (None, None, 2), (3, "twice", 3), (3, "twice", 3), (3, "other", 4),
            (1, "", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").withColumn("file", F.lit("x"))
    back = records.round_trip(df, tokenizer(), 1).collect()
    assert len(back) == 6 and sorted(str(x.doc_id) for x in back) == ["1", "3", "3", "3", "None", "None"]
    order = sorted(back, key=lambda x: x.start)
    assert [x.doc_id for x in order] == [None, None, 1, 3, 3, 3]
    assert [x.start for x in order] == np.cumsum([0] + [x.n_tokens for x in order[:-1]]).tolist()


def test_records_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(records, "TASK_BYTES", 8000)
    r = random.Random(1)
    docs = documents(spark, [" ".join(r.choices(["ab", "cd", "thing"], k=200)) for _ in range(400)])
    tasks = []
    for n in (100, 400):
        folder = new_folder(spark, "records-test")
        manifest = records.write(docs.filter(F.col("doc_id") < n), tokenizer(), 1, folder)
        back = records.read(spark, folder, manifest)
        tasks.append(back.select(F.spark_partition_id()).distinct().count())
        assert back.count() == n
    assert tasks[0] >= 4 and tasks[1] >= 2.5 * tasks[0]


def test_record_files_are_in_order_of_their_number(spark):
    """``start`` follows the number in the name, which has more digits from 100,000 on."""
    folder, rows = new_folder(spark, "records-test"), []
    for first, name in ((0, "part-99999"), (100, "part-100000")):
        other = new_folder(spark, "records-test")
        docs = documents(spark, ["one two", "three"], first).repartition(1)
        row = records.write(docs, tokenizer(), 1, other).first()
        store, root = records._store(folder)
        store.create_dir(root, recursive=True)
        with store.open_input_file(f"{records._store(other)[1]}/{row.file}") as f, \
                store.open_output_stream(f"{root}/{name}.records") as out:
            out.write(f.read())
        rows.append((f"{name}.records", 0, 0, row.bytes, row.records, row.tokens))
    back = records.read(spark, folder, spark.createDataFrame(rows, records._MANIFEST)).collect()
    starts = {x.doc_id: x.start for x in back}
    assert starts[0] == 0 and starts[100] == sum(x.n_tokens for x in back if x.doc_id < 100)


def test_encoder_forgets_and_stays_right(monkeypatch):
    """A cache far too small for its words, against the library."""
    encoder = records.LibraryEncoder(tokenizer())
    encoder.known.size = 20
    r = random.Random(2)
    texts = ["".join(r.choices(list("abAB .,;:!?\n\t<|>İßΣς'\"0-é日\x1c") + ["<|endoftext|>", ". "],
                               k=r.randint(0, 60))) for _ in range(3000)] + [None, ""]
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids,
                         encoder.kind).tobytes() for t in some]
        assert encoder.batch(some) == want
    assert len(encoder.known) <= 20
