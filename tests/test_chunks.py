"""JSON arrays and CSV with line breaks, split at any place, against Python's own readers."""

import csv
import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from shelfmark.schemas import _struct, _L, _S
from shelfmark.sources import chunks
from shelfmark.sources.filters import read_filter_document, read_json_array, write_json_arrays
from shelfmark.sources.tables import read_csv, read_key_column

LETTERS = 'ab",\n\r\\ é{}[]\'/'


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def noise(r, most):
    return "".join(r.choices(LETTERS, k=r.randint(0, most)))


def elements(r, n):
    kinds = [lambda i: {"product_id": i, "filters": [noise(r, 30)] * r.randint(0, 3)},
             lambda i: {"product_id": str(i), "x": {"y": [{}, [{}], "}"]}, "filters": {"a": noise(r, 900)}},
             lambda i: 5.5, lambda i: "}{", lambda i: [{"a": 1}, [2]], lambda i: None, lambda i: {}]
    return [r.choice(kinds)(i) for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_splits(spark, tmp_path, small_splits, indent):
    r, want = random.Random(2), {}
    for f in range(2):
        want[f"{f}.json"] = elements(r, 120)
        (tmp_path / f"{f}.json").write_text(json.dumps(want[f"{f}.json"], indent=indent,
                                                       ensure_ascii=f == 0), encoding="utf-8")
    assert chunks.pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 20
    got = read_json_array(spark, str(tmp_path)).orderBy("file", "position").collect()
    for name, listed in want.items():
        mine = [json.loads(x.element) for x in got if x.file.endswith(name)]
        assert mine == [e for e in listed if isinstance(e, dict)]


def test_json_array_forms(spark, tmp_path):
    def count(text):
        (tmp_path / "d.json").write_text(text, encoding="utf-8")
        return read_json_array(spark, str(tmp_path / "d.json")).count()
    assert [count(t) for t in ("[]", " [ ]\n", '[1,"}"]', '﻿[{"a":"\\\\"},{}]')] == [0, 0, 0, 2]
    for text in ('{"a":1}', '[{"a":1}', '[{"a":1', "", "  ", '[{"a":1}] x', '[{"a":"1]', "5"):
        with pytest.raises(ValueError, match="JSON array"):
            count(text)


def test_filter_document_keeps_order(spark, tmp_path, small_splits):
    entries = [{"product_id": i % 7, "filters": [{"v": i, "pad": "x" * 50}]} for i in range(60)]
    (tmp_path / "f.json").write_text(json.dumps(entries, indent=1))
    rows = read_filter_document(spark, str(tmp_path / "f.json")).orderBy("position").collect()
    assert [(r.product_id, json.loads(r.filters)) for r in rows] == \
        [(str(e["product_id"]), e["filters"]) for e in entries]
    assert "\n" not in rows[0].filters


def test_arrays_written_and_read(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "concat('}', id, '\"') AS t", "double('NaN') AS x").repartition(3)
    for one_line in (True, False):
        write_json_arrays(df, str(tmp_path / "out"), one_line)
        texts = [f.read_text() for f in (tmp_path / "out").glob("part-*")]
        assert sum(len(json.loads(t)) for t in texts) == 50
        assert not one_line or all("\n" not in t for t in texts)
        assert read_json_array(spark, str(tmp_path / "out")).count() == 50
    write_json_arrays(df.filter("id < 10"), str(tmp_path / "some"))
    assert read_json_array(spark, str(tmp_path / "some")).count() == 10


@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\r\n")])
def test_csv_splits(spark, tmp_path, small_splits, sep, end):
    from shelfmark.sources.tables import csv_records
    r, want = random.Random(3), []
    for f in range(2):
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, delimiter=sep, lineterminator=end)
            w.writerow(["a", "b", "n"])
            for i in range(150):
                row = [noise(r, 12), noise(r, 12) if i % 40 else "x\n" * 300, i]
                w.writerow(row)
                want.append((row[0] or None, row[1] or None, i))
        out.close()
    assert chunks.pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 20
    got = csv_records(spark, str(tmp_path), _struct(a=_S, b=_S, n=_L), sep).select("cells.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if sep == ",":
        assert read_csv(spark, str(tmp_path), _struct(a=_S, b=_S, n=_L)).count() == 300
    keys = read_key_column(spark, str(tmp_path), "n").orderBy("file", "position").collect()
    assert [k.key for k in keys] == [str(i) for i in range(150)] * 2


def test_csv_ends(spark, tmp_path):
    def rows(text):
        (tmp_path / "e.csv").write_bytes(text.encode())
        return [tuple(x) for x in read_csv(spark, str(tmp_path / "e.csv"), _struct(a=_S, b=_S)).collect()]
    assert rows("a,b\n1,2") == [("1", "2")]
    assert rows('a,b\n\n1,"x\ny"\n\n') == [("1", "x\ny")]
    assert rows("a,b\n") == [] and rows("") == []
    assert rows('a,b\n5" pipe,2\n3,4\n') == [('5" pipe', "2"), ("3", "4")]
    assert rows('a,b\n"1","un\nclosed') == [("1", "un\nclosed\n")]


def test_a_new_split_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 400)
    form = chunks.csv_lines()
    found = chunks.pieces(spark, str(tmp_path / "a.csv"), form.separator)
    starts = chunks.split_starts(found, form).filter("block > 0")
    with pytest.raises(Exception, match="split anew"):
        chunks.records(found, starts, form).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a",\n', max_size=8), min_size=1, max_size=6))
def test_steps_compose(cells):
    """Composed line by line, the state behind any CSV text is that of reading it from the start."""
    import io
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(cells)
    step, bits = chunks.csv_step(","), [0, 1]
    for line in out.getvalue()[:-1].split("\n"):
        done = step(line)
        bits = [done[b] for b in bits]
    assert bits[0] == 0


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.text('a}"\\{[', max_size=5), lambda x: st.lists(x, max_size=3)
                    | st.dictionaries(st.text('}"', max_size=3), x, max_size=3), max_leaves=12))
def test_json_steps(value):
    text = json.dumps([value])
    bit = depth = 0
    for piece in text.split("}"):
        end0, end1, up0, up1 = chunks.json_step(piece)
        depth += up1 if bit else up0
        bit = end1 if bit else end0
    assert (bit, depth) == (0, -1)
