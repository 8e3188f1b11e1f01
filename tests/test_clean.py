"""Value tables of the scalar cleaning functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import clean
from shelfmark.functions.text import entity_phrases, is_json, json_leaves, strip, tokens


def apply(spark, values, fn, kind="string"):
    """fn over a column of values; results in the order of the values."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.repartition(2).select(fn(F.col("v")).alias("r"), "i")
            .orderBy("i").select("r").collect()]


def test_to_int(spark):
    values = ["5", "5.0", "5.9", " 7 ", "-3.9", "1e2", "abc", "", None, "nan", "5d"]
    assert apply(spark, values, clean.to_int) == [5, 5, 5, 7, -3, 100, None, None, None, None,
                                                  None]


def test_to_float(spark):
    values = ["5", ".5", "5.", "1e-2", "5d", "", None, "x", "inf"]
    assert apply(spark, values, clean.to_float) == [5.0, 0.5, 5.0, 0.01, None, None, None, None,
                                                    math.inf]
    assert math.isnan(apply(spark, ["NaN"], clean.to_float)[0])


def test_price(spark):
    values = ["$1,200.00", "from .99", "10 - 20", "5.", "-3", "—", "", None, "19.99"]
    assert apply(spark, values, clean.parse_price) == [1200.0, 0.99, 10.0, 5.0, -3.0, None, None,
                                                       None, 19.99]


def test_bool01(spark):
    values = ["Yes", "T", "1", "0", "no", "FALSE", "maybe", "", None, " y "]
    assert apply(spark, values, clean.to_bool01) == [1, 1, 1, 0, 0, 0, None, None, None, 1]


def test_timestamp_texts(spark):
    values = ["2020-05-05 14:08:48.923", "2020-05-05T14:08:48Z", "2020-05-05T14:08:48.5Z",
              "2020-05-05T14:08:48+02:00", "2020-05-05", "2020-5-5 1:2:3", "20200505",
              "09 13, 2009", "2020", " ", "", None, "2020-13-01", "2020-05-05 25:00:00"]
    day, at = dt.datetime(2020, 5, 5), dt.datetime(2020, 5, 5, 14, 8, 48)
    assert apply(spark, values, clean.clean_timestamp) == [
        at, at, at, at, day, dt.datetime(2020, 5, 5, 1, 2, 3), day, None, None, None, None, None,
        None, None]


def test_timestamp_numbers(spark):
    number = lambda unit: lambda c: clean.clean_timestamp(c, F.lit(True), unit)
    values = ["1588687728", "1588687728.9", "-5", "1588687728923"]
    at = dt.datetime(2020, 5, 5, 14, 8, 48)
    before = dt.datetime(1969, 12, 31, 23, 59, 55)
    assert apply(spark, values, number("s")) == [at, at, before, None]
    assert apply(spark, values[3:], number("ms")) == [at]
    assert apply(spark, values, number("auto")) == [at, at, before, at]


def test_empty(spark):
    values = [None, "", " \t", "[]", "{}", "NULL", "nan", " [] ", "0", "[ ]", "x"]
    assert apply(spark, values, clean.is_empty) == [True] * 8 + [False] * 3
    assert apply(spark, [float("nan"), 0.0, None], lambda c: clean.is_empty(c, True), "double") \
        == [True, False, True]


def test_strip_all_whitespace(spark):
    assert apply(spark, ["\t a b \n", "　"], strip) == ["a b", ""]


def test_tokens(spark):
    got = apply(spark, ["Café-Noir, 3 oz!", "CAFÉ", "!!!", "Größe_2"], tokens)
    assert got == [["cafe", "noir", "3", "oz"], ["cafe"], [], ["große", "2"]]


@pytest.mark.parametrize("text, ok", [
    ('{"a":1}', True), ('[1,2]', True), ('"x"', True), ('{"a":1} x', False),
    ('{"a":1}{"b":2}', False), ('{"a":1}]', False), ('{"a":', False), ('', False),
    ('1,2', False)])
def test_is_json(spark, text, ok):
    assert apply(spark, [text], is_json) == [ok]


def test_json_leaves(spark):
    nested = '{"b":[" x ",1.50,true,null,{"a":"q\\"{:","c":[[["deep"]]]}],"a":"","k:":"v"}'
    long = '["' + "ab\\\\ " * 20000 + '"]'
    got = apply(spark, [nested, "not json", None, '"one"', "[]", '{"a":1} x', long], json_leaves)
    assert got[0] == ["x", "1.5", "True", 'q"{:', "deep", "v"]
    assert got[1:6] == [[], [], ["one"], [], []]
    assert got[6] == [("ab\\ " * 20000).strip()]


def test_entities(spark):
    got = apply(spark, ["new Sony WH1000 in Black", "plain words", "The 2nd 12 Tools"],
                entity_phrases)
    assert got == [["Sony WH1000", "Black"], ["plain words"], ["The", "Tools"]]


def test_repair(spark):
    values = ["{'a': 'b'}", '{"a": "b"}', "it's", "{bad'}"]
    assert apply(spark, values, clean.repair_json_text) == ['{"a": "b"}', '{"a": "b"}', "it's",
                                                            "{bad'}"]
