import csv
import hashlib
import io
import json
import os
import pathlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from factstore.operators import dedup, records, validate
from factstore.plans import catalog
from factstore.sources import conversations, imports, markdown, tables


def items_of(spark, values, user="u"):
    rows = [(user, i, json.dumps(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "user_id string, pos long, data string")
    return imports.parse_items(df.withColumn("item", F.parse_json("data")).drop("data"))


def store_of(spark, texts, user="u"):
    return spark.createDataFrame([(f"s{i}", t, user, None) for i, t in enumerate(texts)],
                                 "id string, memory string, user_id string, metadata string")


def report(result):
    return {r["user_id"]: (r["imported"], r["skipped"], r["failed"], r["errors"])
            for r in dedup.import_report(result).collect()}


def test_failures_are_counted_and_explained(spark):
    values = [1, "s", 2.5, True, None, [1], {"memory": ""}, {"memory": "  \n "}, {"text": "  "}, {"memory": ["x"]}]
    result = dedup.import_memories(items_of(spark, values), store_of(spark, []))
    got = report(result)["u"]
    assert got[:3] == (0, 0, 10)
    assert {(e["message"], e["n"]) for e in got[3]} == {
        (f"Non-dict item skipped: {t}", 1) for t in ("int", "str", "float", "bool", "NoneType", "list")} | {
        ("Empty memory text, skipped", 3), ("Memory text is not a string, skipped", 1)}
    assert result.rejects.count() == 10 and result.new_rows.count() == 0


def test_existing_text_is_skipped_whatever_its_case(spark):
    result = dedup.import_memories(items_of(spark, [{"memory": "blue door"}]), store_of(spark, ["  Blue Door "]))
    assert report(result) == {"u": (0, 1, 0, None)}
    other = dedup.import_memories(items_of(spark, [{"memory": "blue door"}]), store_of(spark, ["Blue Door"], "v"))
    assert report(other) == {"u": (1, 0, 0, None)}


def test_first_of_a_batch_wins(spark):
    values = [{"memory": "Tea At Four"}, {"memory": "tea at four"}, {"memory": "new rope"}, {"text": " TEA at four "}]
    result = dedup.import_memories(items_of(spark, values).repartition(4), store_of(spark, []))
    assert sorted(r["memory"] for r in result.new_rows.collect()) == ["Tea At Four", "new rope"]
    assert report(result) == {"u": (2, 2, 0, None)}
    assert {r["pos"]: r["status"] for r in dedup.import_status(result).collect()} == {
        0: "imported", 1: "skipped", 2: "imported", 3: "skipped"}


def test_text_member_order_and_scalars(spark):
    values = [{"memory": "", "text": "t", "content": "c"}, {"content": "c", "id": "x", "user_id": "other"},
              {"memory": 0, "text": 12}, {"memory": True}, {"memory": "0"}, {"memory": "false", "metadata": {"n": 1, "a": [True]}}]
    result = dedup.import_memories(items_of(spark, values), store_of(spark, []))
    got = {r["pos"]: r for r in result.new_rows.collect()}
    assert {p: r["memory"] for p, r in got.items()} == {0: "t", 1: "c", 2: "12", 3: "True", 4: "0", 5: "false"}
    assert got[1]["user_id"] == "u" and got[1]["id"] != "x" and got[1]["metadata"] is None
    assert json.loads(got[5]["metadata"]) == {"n": 1, "a": [True]}
    again = {r["pos"]: r["id"] for r in result.new_rows.collect()}
    assert again == {p: r["id"] for p, r in got.items()}


def test_one_key_in_most_rows(spark):
    values = [{"memory": "same"} if i % 3 else {"memory": f"n{i}"} for i in range(300)]
    result = dedup.import_memories(items_of(spark, values).repartition(16), store_of(spark, []))
    assert report(result) == {"u": (101, 199, 0, None)}
    both = dedup.union_store(store_of(spark, ["a"]), result.new_rows)
    assert both.count() == 102 and both.columns == ["id", "memory", "user_id", "metadata"]


def test_json_array_batches(spark):
    df = spark.createDataFrame([("u", '[{"memory":"a"}, 5]'), ("v", "[]"), ("w", "{")], "user_id string, data string")
    got = imports.read_json_array(validate.accepted(validate.validate_batches(df))).orderBy("pos").collect()
    assert [(r["user_id"], r["pos"], r["item_type"], r["memory"]) for r in got] == [("u", 0, "dict", "a"), ("u", 1, "int", None)]


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.mark.parametrize("name,text,want", [
    ("array", '[{"memory":"a"},"b",{"text":"c"}]', ["a", "b", "c"]),
    ("envelope", '{"format":"json","count":1,"memories":[{"memory":"a"}]}', ["a"]),
    ("single", '\n {"memory":"a",\n"metadata":{"k":1}} ', ["a"]),
    ("bare", '"just text"', ["just text"]),
    ("lines", '{"memory":"a"}\n\n"b"\n{"content":"c"}\n', ["a", "b", "c"]),
    ("csv", 'id,memory,metadata\n1,"a, ""quoted""\nline",{}\n2,b,\n', ['a, "quoted"\nline', "b"]),
    ("tsv", "id\tmemory\n1\ta, b\n", ["a, b"]),
])
def test_payload_formats(spark, tmp_path, name, text, want):
    got = imports.read_import(spark, write(tmp_path / name, text)).orderBy("pos").collect()
    assert [r["memory"] for r in got] == want


def test_payload_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Nothing to import"):
        imports.read_import(spark, write(tmp_path / "empty", "  \n"))
    with pytest.raises(ValueError, match="Not valid"):
        imports.read_import(spark, write(tmp_path / "junk", "what is this\n"))
    with pytest.raises(ValueError, match="no memory column"):
        imports.read_import(spark, write(tmp_path / "c.csv", "id,memoryx\n1,2\n"))
    with pytest.raises(ValueError, match="fmt"):
        imports.read_import(spark, str(tmp_path), "xml")
    bad = imports.read_import(spark, write(tmp_path / "l", '{"memory":"a"}\nbroken\n'), "jsonl")
    result = dedup.import_memories(bad.withColumn("user_id", F.lit("u")), store_of(spark, []))
    assert report(result)["u"][:3] == (1, 0, 1)


def text_of(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return b"".join(open(os.path.join(folder, p), "rb").read() for p in parts).decode()


RECORDS = [("abc", "salt, then pepper", '{"k": "v"}', "2025-01-01", "bob"), ("d", 'q "x"\nline\r\n', "{}", "", "bob"),
           ("e", "plain", None, None, "ann")]


def record_table(spark):
    return spark.createDataFrame(RECORDS, "id string, memory string, metadata string, created_at string, user_id string")


def test_csv_export_is_byte_exact(spark, tmp_path):
    manifest = tables.export(record_table(spark).coalesce(1), str(tmp_path / "one"), "csv", "bob")
    text = text_of(tmp_path / "one")
    assert text.startswith("id,memory,metadata,created_at,user_id\r\n"
                           'abc,"salt, then pepper","{""k"": ""v""}",2025-01-01,bob\r\n')
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(["id", "memory", "metadata", "created_at", "user_id"])
    writer.writerow(RECORDS[0])
    writer.writerow(["d", 'q "x"\nline\r\n', "", "", "bob"])
    assert text == out.getvalue()
    assert [tuple(r) for r in manifest.collect()] == [("bob", 2, "csv")]
    tables.export(record_table(spark).where("false"), str(tmp_path / "none"), "csv")
    assert text_of(tmp_path / "none") == "id,memory,metadata,created_at,user_id\r\n"


def test_csv_export_of_many_partitions_reads_as_one_file(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").cast("string"), F.lit("x,y").alias("memory"), F.lit("u").alias("user_id"))
    tables.export(rows.repartition(6), str(tmp_path / "many"), "csv")
    lines = list(csv.reader(io.StringIO(text_of(tmp_path / "many"))))
    assert lines[0][0] == "id" and sorted(int(r[0]) for r in lines[1:]) == list(range(500))
    tables.export_csv(records.export_records(rows), str(tmp_path / "quoted"), "quoted")
    assert text_of(tmp_path / "quoted").splitlines()[1].count('"') == 10


def test_json_round_trip(spark, tmp_path):
    source = record_table(spark)
    manifest = tables.export(source, str(tmp_path / "j"))
    assert {r["user_id"]: r["count"] for r in manifest.collect()} == {"bob": 2, "ann": 1}
    items = imports.read_import(spark, str(tmp_path / "j" / "memories"), "jsonl").withColumn("user_id", F.lit("copy"))
    first = dedup.import_memories(items, store_of(spark, []), batch="a")
    assert report(first) == {"copy": (3, 0, 0, None)}
    second = dedup.import_memories(items, first.new_rows, batch="b")
    assert report(second) == {"copy": (0, 3, 0, None)}
    assert first.new_rows.select("memory").exceptAll(source.select("memory")).count() == 0


def test_append_scan_and_pruned_directories(spark, tmp_path):
    place = str(tmp_path / "store")
    rows = spark.range(200).select(F.concat(F.lit("u"), F.col("id") % 5).alias("user_id"), F.col("id").cast("string").alias("memory"))
    first = tables.new_records(rows, "b1", ["user_id", "memory"], "2025-01-01")
    tables.append(first, place, buckets=8)
    tables.append(tables.new_records(rows, "b2", ["user_id", "memory"]), place, buckets=8)
    got = tables.scan(spark, place, "u3")
    assert got.count() == 80 and got.select("id").distinct().count() == 80
    assert tables.scan(spark, place).count() == 400 and tables.scan(spark, place, "u3", 5).count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace_of_8" in plan
    ids = {r["id"] for r in first.collect()}
    assert ids == {r["id"] for r in first.collect()}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    with pytest.raises(ValueError, match="no snapshot"):
        tables.read_snapshot(spark, root)
    df = record_table(spark)
    assert tables.write_snapshot(df, root, 4) == 1
    kept = tables.read_snapshot(spark, root).where("user_id = 'bob'")
    assert tables.write_snapshot(kept, root, 4) == 2
    assert tables.read_snapshot(spark, root).count() == 2 and tables.read_snapshot(spark, root, 1).count() == 3
    os.makedirs(os.path.join(root, "version=3"))  # a write that never finished
    assert tables.snapshot_versions(spark, root) == [1, 2]
    assert tables.read_snapshot(spark, root, user_id="ann").count() == 0


def files_of(root):
    return {str(p.relative_to(root)) for p in pathlib.Path(root).rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([(str(i), f"text {i}", f"u{i % 20}") for i in range(200)], "id string, memory string, user_id string")
    tables.write_snapshot(df, root, 8)
    before, first = files_of(root), tables._snapshot(spark, root, 1)
    ids = spark.createDataFrame([("3",), ("23",), ("none",)], "id string")
    gone = lambda store: store.join(ids, "id", "left_semi")
    assert tables.change_snapshot(spark, root, gone, lambda store: store.join(ids, "id", "left_anti")) == 2
    second = tables._snapshot(spark, root, 2)
    # Both rows are of one namespace, so one of the buckets has files of its own now.
    assert sum(first["paths"][k] != second["paths"].get(k) for k in first["paths"]) == 1
    assert before < files_of(root)
    assert {r["id"] for r in tables.read_snapshot(spark, root).collect()} == {str(i) for i in range(200)} - {"3", "23"}
    assert tables.read_snapshot(spark, root, 1).count() == 200
    assert tables.read_snapshot(spark, root, user_id="u3").count() == 8
    assert tables.change_snapshot(spark, root, gone, lambda store: store) == 2  # nothing is left to change
    moved = lambda store: store.where("user_id = 'u5'")
    tables.change_snapshot(spark, root, moved, lambda store: store.withColumn("user_id", F.expr("if(user_id = 'u5', 'u6', user_id)")))
    assert tables.read_snapshot(spark, root, user_id="u6").count() == 20 and tables.read_snapshot(spark, root).count() == 198


def test_of_two_writers_one_tries_again(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([(str(i), f"u{i % 4}") for i in range(40)], "id string, user_id string")
    tables.write_snapshot(df, root, 4)
    tries = []

    def change(store):
        tries.append(1)
        if len(tries) == 1:  # another job is faster
            assert tables.change_snapshot(spark, root, lambda s: s.where("id = '7'"), lambda s: s.where("id <> '7'")) == 2
        return store.where("id <> '1'")

    assert tables.change_snapshot(spark, root, lambda s: s.where("id = '1'"), change) == 3
    assert len(tries) == 2
    assert {r["id"] for r in tables.read_snapshot(spark, root).collect()} == {str(i) for i in range(40)} - {"1", "7"}
    with ThreadPoolExecutor(4) as pool:
        drop = lambda i: tables.change_snapshot(spark, root, lambda s: s.where(f"id = '{i}'"), lambda s: s.where(f"id <> '{i}'"))
        assert sorted(pool.map(drop, [10, 11, 12, 13])) == [4, 5, 6, 7]
    assert tables.read_snapshot(spark, root).count() == 34


def test_a_writer_that_broke_off_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "CLAIM_SECONDS", 0.5)
    root = tmp_path / "snap"
    tables.write_snapshot(spark.createDataFrame([("1", "u"), ("2", "u")], "id string, user_id string"), str(root), 4)
    (root / "version=2").mkdir()
    assert tables.change_snapshot(spark, str(root), lambda s: s.where("id = '1'"), lambda s: s.where("id <> '1'")) == 3
    assert [r["id"] for r in tables.read_snapshot(spark, str(root)).collect()] == ["2"]


def test_markdown_discovery(spark, tmp_path):
    for name, data in {"b.md": b"x\xffy\r\nz\rw", "a/z.md": b"z", "a.md": b"top", "note.txt": b"no",
                       "node_modules/m.md": b"no", "deep/dist/m.md": b"no", "deep/er/m.md": b"\xc3\xa9"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    got = markdown.in_path_order(markdown.read_markdown(spark, str(tmp_path))).collect()
    assert [(r["file"], r["n_bytes"], r["text"]) for r in got] == [
        ("a/z.md", 1, "z"), ("a.md", 3, "top"), ("b.md", 8, "x�y\nz\nw"), ("deep/er/m.md", 2, "é")]
    with pytest.raises(ValueError):
        markdown.read_markdown(spark, str(tmp_path / "missing"))


def test_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f'say "{t}"') for t in range(5)] + [(2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r["conv_id"], r["part"]): json.loads(r["memory"]) for r in conversations.conversations_to_memories(df).collect()}
    assert got[1, 0][0] == {"role": "user", "content": 'say "0"'} and len(got[1, 0]) == 5
    assert got[2, 0] == [{"role": "user", "content": ""}]
    parts = conversations.conversations_to_memories(df, turns_per_memory=2).orderBy("conv_id", "part").collect()
    assert [(r["conv_id"], r["part"], r["messages"]) for r in parts] == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 1)]


def test_many_json_files(spark, tmp_path):
    for i in range(4):
        value = [{"memory": f"m{i}{j}"} for j in range(3)]
        write(tmp_path / f"f{i}.json", json.dumps(value if i % 2 else {"memories": value}, indent=1))
    items = imports.read_import(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["memory"] for r in items] == [f"m{i}{j}" for i in range(4) for j in range(3)]


def test_order_does_not_depend_on_splits(spark, tmp_path):
    write(tmp_path / "lines.jsonl", "".join(json.dumps({"memory": f"line {i}"}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        items = imports.read_import(spark, str(tmp_path))
        assert items.rdd.getNumPartitions() > 3
        assert [r["memory"] for r in items.orderBy("pos").collect()] == [f"line {i}" for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_own_csv_export_of_many_parts(spark, tmp_path):
    rows = [(f"i{i}", f"text, {i}\r\nnext \r lone", "{}", "", "u") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, memory string, metadata string, created_at string, user_id string")
    tables.export_csv(df.repartition(4), str(tmp_path / "out"))
    for fmt in ("csv", "auto"):
        got = imports.read_import(spark, str(tmp_path / "out"), fmt)
        assert sorted(r["memory"] for r in got.collect()) == sorted(r[1] for r in rows)


def test_json_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    texts = [(1 if i % 3 else i, i % 7, "user", f"text {i}") for i in range(5000)]
    (spark.createDataFrame(texts, "conv_id bigint, turn bigint, role string, text string")
     .write.parquet(str(tmp_path / "conversations.parquet")))
    monkeypatch.setattr(catalog, "shared_folder", lambda _, label: str(tmp_path / label))
    got = sorted(r["memory_md5"] for r in catalog.import_json_files(spark, str(tmp_path)).collect())
    assert got == sorted(hashlib.md5(t[3].encode()).hexdigest() for t in texts)
    found = [json.loads(f.read_text()) for f in (tmp_path / "json").glob("*/part-*")]
    assert {type(v) for v in found} == {list, dict}
    sizes = [len(v if isinstance(v, list) else v["memories"]) for v in found]
    assert sum(sizes) == 5000 and max(sizes) <= 500


def test_csv_files_are_cut_into_records_once(spark, tmp_path):
    """What finds the header and what drops it reads the records and not the files."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,memory\n1,"two\nlines"\n2,b\n')
    (tmp_path / "in" / "b.csv").write_text("3,c\n")
    found = imports.read_import(spark, str(tmp_path / "in"), "csv")
    assert "FileScan text" not in found._jdf.queryExecution().toString()
    assert sorted(r["memory"] for r in found.collect()) == ["b", "c", "two\nlines"]
