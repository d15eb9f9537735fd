import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factstore.functions.dates import parse_created_at
from factstore.functions.numbers import float_or, int_or
from factstore.functions.text import (
    canonical_model, csv_field, dedup_key, json_put, metadata_cell, py_strip, record_id, relative_path,
    strict_json)
from factstore.functions.vectors import cosine, unit


def test_strip_and_key_agree_with_python(one):
    texts = ["  a b 　", "\x1c\x85x y ", "", " \t\n", " é ", "ΑΣ", "Blue Door ", "ẞ"]
    assert one(texts, py_strip("c")) == [t.strip() for t in texts]
    assert one(texts, dedup_key("c")) == [t.strip().lower() for t in texts]


# Creation times and their epoch seconds; null for what is no time.
EPOCHS = [
    ("2020-01-01T00:00:00", 1577836800.0),
    ("2020-01-01T00:00:00Z", 1577836800.0),
    ("0.0", 0.0),
    ("2020-01-01", 1577836800.0),
    ("not a date", None),
    ("", None),
    ("20200101", 20200101.0),
    ("2020-01-01 10:00:00", None),
    ("2020-01-01Z", None),
    ("2020-01-01T10:00Z", 1577872800.0),
    ("2020-01-01T10", 1577872800.0),
    ("2020-01-01T10:00:00,5", 1577872800.5),
    ("2020-01-01T10:00:00.1234567", 1577872800.123456),
    ("20200101T000000", 1577836800.0),
    ("20200101T0102", 1577840520.0),
    ("2020-W05-1", 1580083200.0),
    ("2020-W53-7", 1609632000.0),
    ("2021-W53-1", None),
    ("2020W051", 1580083200.0),
    ("2020-01-01T10:00:00+0530", 1577853000.0),
    ("2020-01-01T10:00:00+05:30:15", 1577852985.0),
    ("2020-01-01T10:00:00-08:00", 1577901600.0),
    ("2020-13-01", None),
    ("2020-02-30", None),
    ("2020-01-01T23:59:60", None),
    ("2020-01-01T24:01:00", None),
    (".5", 0.5),
    ("1.", 1.0),
    ("1.2.3", None),
    (".", None),
    ("  2020-01-01T00:00:00\n", 1577836800.0),
    ("1577836800", 1577836800.0),
    ("1577836800.25", 1577836800.25),
    ("T", None),
    ("Tuesday", None),
    ("2020-01-01T", None),
    ("0000-01-01", None),
    ("2020-01-01T10:00:00+25:00", None),
    ("-5", None),
    ("+5", None),
    ("1e5", None),
    ("2020-1-1", None),
    ("9999-12-31T23:59:59", 253402300799.0),
    ("2020-01-01T10:00:00+01", 1577869200.0),
]


def test_created_at(one):
    got = one([text for text, _ in EPOCHS], parse_created_at("c"))
    assert list(zip([text for text, _ in EPOCHS], got)) == EPOCHS


def test_created_at_ignores_the_session_zone(spark, one):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(["2020-01-01", "2020-07-01T12:00:00"], parse_created_at("c")) == [1577836800.0, 1593604800.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tolerant_numbers(one):
    assert one(["42", " 7 ", "x", None, "4.7", "", "-3", "1_000"], int_or("c", 9)) == [42, 7, 9, 9, 9, 9, -3, 1000]
    got = one(["1.5", "x", "1d", "1e3", "nan", "-inf", None], float_or("c", 0.25))
    assert got[:4] == [1.5, 0.25, 0.25, 1000.0] and math.isnan(got[4]) and got[5:] == [-math.inf, 0.25]


def test_csv_field_quotes_only_when_needed(one):
    assert one(["plain", "a,b", 'q"q', "x\ny", "", None, "a b"], csv_field("c")) == [
        "plain", '"a,b"', '"q""q"', '"x\ny"', "", "", "a b"]


def test_metadata_cell(one):
    assert one(['{"k": "v"}', "{}", "", None], metadata_cell("c")) == ['{"k": "v"}', "", "", ""]


def test_json_put_keeps_value_types(one):
    got = one(['{"n":1,"b":true,"chunk":"9/9","x":{"y":[1,2]}}', None, "{}"], json_put("c", "chunk", F.lit("1/2")))
    assert [json.loads(g) for g in got] == [
        {"n": 1, "b": True, "chunk": "1/2", "x": {"y": [1, 2]}}, {"chunk": "1/2"}, {"chunk": "1/2"}]


def test_model_names(one):
    known = "nomic-ai/nomic-embed-text-v1.5"
    assert one([" nomic-embed-text ", "nomic-embed-text:v1.5", "nomic-embed-text-v1.5", " other/model "],
               canonical_model("c")) == [known, known, known, "other/model"]


def test_relative_path(one):
    assert one(["file:/a/b/c.md", "file:/a/x.md", "/other"], relative_path("c", "file:/a")) == ["b/c.md", "x.md", "/other"]


def test_record_id_is_stable_and_distinct(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "a")], "x string, y string")
    first, second = ([r["v"] for r in df.select(record_id("x", "y").alias("v")).collect()] for _ in range(2))
    assert first == second and len(set(first)) == 4
    assert all(len(v) == 36 and v.count("-") == 4 for v in first)


def test_cosine_and_unit(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0]),
            ([1.0], [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got == [1.0, 0.0, None, pytest.approx(0.96), None, None]
    units = [r[0] for r in df.select(unit("a")).collect()]
    assert units[2] is None and np.allclose(units[3], [0.6, 0.8])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30).filter(lambda t: "\ud800" not in t), min_size=1, max_size=20))
def test_strip_property(one, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert one(texts, py_strip("c")) == [t.strip() for t in texts]


def test_strict_json(one):
    texts = ['{"a":1}', '{"a":1} x', "1,2", "1] x", "1} x", '"s"', "null", "", "[1]\n[2]", " [1, 2] ", '1,"v":2', None, "1]}"]
    assert one(texts, strict_json("c").isNotNull()) == [t in ('{"a":1}', '"s"', "null", " [1, 2] ") for t in texts]


def test_the_last_of_equal_keys_counts(one):
    assert one(['{"a":1,"a":2}'], F.to_json(strict_json("c"))) == ['{"a":2}']
