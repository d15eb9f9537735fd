"""Large files read by ranges give what reading them as a whole gives, however they are cut."""

import csv
import io
import json
import random

import pytest

from factstore.sources import imports, ranges


@pytest.fixture
def small_ranges(spark, monkeypatch):
    monkeypatch.setattr(imports, "WHOLE_BYTES", 0)
    settings = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield 150
    for key in settings:
        spark.conf.unset(key)


def items(rng, n):
    texts = ['plain', 'a "quoted" word', 'braces } { ] [', 'slash \\ and \\" more', '}', '"', '\\', 'line\nend', 'ü{é}', '', ',']
    out = []
    for _ in range(n):
        kind = rng.random()
        deep = {"a": [1, {"b": rng.choice(texts)}, []], "}": {"]": rng.choice(texts)}}
        out.append({"memory": rng.choice(texts), "metadata": deep} if kind < 0.5 else {"text": rng.choice(texts)} if kind < 0.7
                   else rng.choice([rng.choice(texts), 17, None, True, [1, "x"], {}, [{"memory": "nested"}]]))
    return out


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("pos").collect()]


def by_file(df):
    out = {}
    for r in df.orderBy("pos").collect():
        out.setdefault(r["pos"]["file"].rsplit("/", 1)[1], []).append(tuple(r)[1:])
    return out


def whole(spark, path):
    return imports.parse_items(imports._wrap_strings(imports._read_whole(imports._texts(spark, str(path))))).select(*imports.ITEM_COLUMNS)


def shapes(rng):
    some = items(rng, 14)
    yield "array", json.dumps(some)
    yield "pretty", json.dumps(some, indent=2, ensure_ascii=False) + "\n"
    yield "no-objects", json.dumps([1, "a}", [2], None])
    yield "empty", " [ ] "
    yield "one", '[{"memory":"x"}]'
    yield "behind", '[{"memory":"x"}, 1, "y" ]\n'
    yield "envelope", json.dumps({"format": "js\"}on", "count": 3, "memories": some})
    yield "envelope-tail", json.dumps({"format": "json", "memories": some, "user_id": "a}]\\", "n": 1.5, "t": True}, indent=1)
    yield "envelope-empty", '{"memories":[]}'
    yield "other-members", json.dumps({"old": [{"memory": "no"}], "memories": some, "more": [{"memory": "no"}, {"memory": "nor"}]})
    yield "twice", '{"memories":[{"memory":"a"}],"memories":[{"memory":"b"},{"memory":"c"}]}'
    yield "object", json.dumps({"memory": "alone", "metadata": {"a": {"b": {}}}})
    yield "value", "17"
    yield "nested", json.dumps([[{"memory": "a"}, {"memory": "b"}], {"memory": "c"}])
    for name, broken in (("comma", '[{"memory":"a"},,{"memory":"b"}]'), ("no-comma", '[{"memory":"a"} {"memory":"b"}]'),
                         ("trailing", '[{"memory":"a"},]'), ("open", '[{"memory":"a"}'), ("more", '[{"memory":"a"}] 5'),
                         ("brace", '[{"memory":"a"}}]'), ("leading", '[,{"memory":"a"}]'), ("quote", '[{"memory":"a}]'),
                         ("mixed", '{"memories":[{"memory":"a"}]'), ("array-tail", '[{"memory":"a"}],"x":1}')):
        yield f"broken-{name}", broken


def test_many_files_by_ranges(spark, tmp_path, small_ranges, monkeypatch):
    """Large and small files, sound and broken ones, in one folder; small ones are read as a whole."""
    rng = random.Random(3)
    for name, text in shapes(rng):
        (tmp_path / f"{name} ü.json").write_text(text, encoding="utf-8")
    want = whole(spark, tmp_path)
    for size in (0, 100):
        monkeypatch.setattr(imports, "WHOLE_BYTES", size)
        found = imports.read_import(spark, str(tmp_path), "json")
        assert by_file(found) == by_file(want)


def test_one_array_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"memory": f"m {i} }}"} for i in range(5000)]), encoding="utf-8")
    monkeypatch.setattr(imports, "WHOLE_BYTES", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = ranges._lines(spark, str(path), ranges.JsonScan(), 1000)
        assert lines.rdd.getNumPartitions() >= 8
        found = imports.read_import(spark, str(path), "json")
        assert [r["memory"] for r in found.orderBy("pos").collect()] == [f"m {i} }}" for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_by_ranges(spark, tmp_path, small_ranges, ending):
    rng = random.Random(small_ranges)
    cells = ["a", 'q "x" y', "two\nlines", "a,b", "", "ü", "\r\n", '"', "x" * 60, "id", "memory"]
    made = [("id", "memory", "metadata")] + [(str(i), rng.choice(cells[:-3]) + rng.choice(cells), rng.choice(["{}", '{"a": "b\n}"}', ""]))
                                             for i in range(40)]
    made.insert(20, ("id", "memory", "metadata"))  # a record like the header stands in the middle
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(made)
    path = tmp_path / "rows.csv"
    path.write_bytes((out.getvalue() + ending).encode())
    read = list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:]
    found = imports._read_table(spark, str(path), ",").orderBy("pos").collect()
    assert [r["memory"] or "" for r in found] == [m for _, m, _ in read]
    assert sum(r["memory"] == "memory" for r in found) == sum(m == "memory" for _, m, _ in read) >= 1


def test_odd_quotes(spark, tmp_path, small_ranges):
    path = tmp_path / "odd.csv"
    path.write_text('id,memory\n1,5" pipe\n2,"closed"then more\n3,"open ""twice"""\n4, "blank first"\n5,""\n6,x', encoding="utf-8")
    found = imports._read_table(spark, str(path), ",").orderBy("pos").collect()
    assert [r["memory"] for r in found][:1] + [r["memory"] for r in found][2:4] == ['5" pipe', 'open "twice"', ' "blank first"']
    assert len(found) == 6 and found[5]["memory"] == "x"
