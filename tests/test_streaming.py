import json
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from factstore.operators import chunks, dedup
from factstore.sources import imports
from factstore.streaming import ingest


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_ingest_stream_equals_the_batch(spark, tmp_path):
    source, target, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    rows = [{"request_id": str(i), "content": "w" * (i * 7) if i % 4 else " ", "user_id": "u" if i % 2 else None}
            for i in range(1, 40)]
    write_lines(source / "1.json", rows[:20])

    def go():
        stream = ingest.read_requests(spark, str(source), max_files=1)
        run(ingest.ingest_stream(stream, str(target), str(state), max_chars=50, created_at="2025-01-01"))

    go()
    write_lines(source / "2.json", rows[20:])
    go()
    go()  # nothing new arrives
    batch = spark.read.schema(ingest.ADD_REQUEST).json(str(source))
    want, failed = chunks.add_verbatim(batch, max_chars=50)
    got = spark.read.parquet(f"{target}/records")
    columns = ["request_id", "user_id", "pos", "n_chunks", "memory", "metadata"]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0 and got.count() == want.count()
    assert got.select("id").distinct().count() == got.count()
    rejects = spark.read.parquet(f"{target}/rejects")
    assert sorted(r["request_id"] for r in rejects.collect()) == sorted(r["request_id"] for r in failed.collect())


def test_import_stream_skips_what_any_earlier_batch_stored(spark, tmp_path):
    source, target, state, base = (tmp_path / n for n in ("in", "out", "state", "base"))
    source.mkdir()
    texts = ["Alpha", "beta", "alpha ", "gamma", "BETA", "known", "delta", "gamma", "", "epsilon"]
    rows = [{"user_id": "u", "pos": i, "data": json.dumps({"memory": t})} for i, t in enumerate(texts)]
    rows.append({"user_id": "u", "pos": 99, "data": "not json"})
    store = spark.createDataFrame([("s", "u", " Known ")], "id string, user_id string, memory string")
    ingest.write_base_keys(store, str(base))

    def go():
        stream = (spark.readStream.schema("user_id string, pos long, data string")
                  .option("maxFilesPerTrigger", 1).json(str(source)))
        run(ingest.import_stream(stream, str(target), str(state), str(base), created_at="2025-01-01"))

    write_lines(source / "1.json", rows[:4])
    go()
    write_lines(source / "2.json", rows[4:7])
    go()
    # Neither the base nor the digests of earlier batches are read again.
    spoilt = [f for folder in (base, f"{state}-keys/keys") for f in Path(folder).rglob("*.parquet")]
    assert len(spoilt) >= 3
    for file in spoilt:
        file.write_bytes(b"no longer a table")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    write_lines(source / "3.json", rows[7:])
    go()
    got = spark.read.parquet(f"{target}/records")
    assert sorted(r["memory"] for r in got.collect()) == ["Alpha", "beta", "delta", "epsilon", "gamma"]

    items = spark.createDataFrame([(r["user_id"], r["pos"], r["data"]) for r in rows], "user_id string, pos long, data string")
    parsed = imports.parse_items(items.withColumn("item", F.coalesce(F.try_parse_json("data"), F.parse_json(F.lit("null")))).drop("data"))
    want = dedup.import_memories(parsed, store, batch="stream").new_rows
    assert {(r["id"], r["memory"]) for r in got.collect()} == {(r["id"], r["memory"]) for r in want.collect()}
    assert spark.read.parquet(f"{target}/rejects").count() == 2


def test_a_replayed_batch_replaces_its_own_output(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write_lines(source / "1.json", [{"user_id": "u", "pos": i, "data": json.dumps({"memory": f"m{i % 3}"})} for i in range(9)])
    for state in ("first", "second"):  # a lost checkpoint runs batch 0 again
        stream = spark.readStream.schema("user_id string, pos long, data string").json(str(source))
        run(ingest.import_stream(stream, str(target), str(tmp_path / state), created_at="2025-01-01"))
    got = spark.read.parquet(f"{target}/records")
    assert sorted(r["memory"] for r in got.collect()) == ["m0", "m1", "m2"]


def test_a_batch_that_broke_off_is_completed(spark, tmp_path):
    """The digests of a batch are known when it runs again; its records are written all the same."""
    source, target, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    write_lines(source / "1.json", [{"user_id": "u", "pos": i, "data": json.dumps({"memory": f"m{i % 3}"})} for i in range(9)])

    def go():
        stream = spark.readStream.schema("user_id string, pos long, data string").json(str(source))
        run(ingest.import_stream(stream, str(target), str(state), created_at="2025-01-01"))

    go()
    write_lines(source / "2.json", [{"user_id": "u", "pos": i, "data": json.dumps({"memory": f"m{i}"})} for i in range(6)])
    go()
    # As if the second batch had not been committed, nor its records written.
    (state / "commits" / "1").unlink()
    (state / "commits" / ".1.crc").unlink(missing_ok=True)
    shutil.rmtree(target / "records" / "batch_id=1")
    go()
    got = spark.read.parquet(f"{target}/records")
    assert sorted((r["memory"], r["batch_id"]) for r in got.collect()) == [("m0", 0), ("m1", 0), ("m2", 0), ("m3", 1), ("m4", 1), ("m5", 1)]
