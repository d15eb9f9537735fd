"""Rules for scale: no caps, no machine-local folders on a cluster, ids that hold."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from factstore.operators import audit, mutate, records
from factstore.session import shared_folder
from factstore.sources import tables
from factstore.streaming import ingest


def fake_session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if folder else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(
        master=master, getConf=lambda: SimpleNamespace(get=lambda key: folder)))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake_session("spark://host:7077"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake_session("local-cluster[2,1,1024]"), "x")
    assert shared_folder(fake_session("yarn", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert shared_folder(fake_session("local[2]"), "x").rsplit("/", 1)[1].startswith("x-")


def test_audit_message_counts_everything(spark):
    wrong = {f"c{i:02}": spark.range(3).select(F.array_repeat(F.lit(0.0), i + 1).alias("embedding")) for i in range(30)}
    with pytest.raises(audit.DimensionMismatch, match="90 rows of 30 other sizes in 30 collections, first 'c00'"):
        audit.enforce_dims(wrong, 64)


def test_listings_are_whole_and_ordered_by_time(spark, tmp_path):
    stamps = ["2020-01-01T00:00:00", "1700000000", "not a date", "2021-05-05", None]
    rows = [(f"m{i:03}", "u", stamps[i % 5], "text") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, user_id string, created_at string, memory string")
    assert records.list_namespace(df, "u").count() == 120
    tables.append(df, str(tmp_path / "t"))
    assert tables.list_page(spark, str(tmp_path / "t"), "u").count() == 120
    times = [r["created_at"] for r in records.page(df, "u", 120, 1).collect()]
    assert set(times[:48]) == {"not a date", None}
    assert times[48:] == ["2020-01-01T00:00:00"] * 24 + ["2021-05-05"] * 24 + ["1700000000"] * 24


def test_prune_takes_legacy_ids(spark):
    rows = [("a", None, "2020-01-01"), (None, "b", "2020-01-01"), ("", "c", "2020-01-01"), (None, None, "2020-01-01"),
            (None, "d", "2999-01-01")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "id string, memory_id string, created_at string, memory string")
    done = mutate.prune(df, 1.7e9, 30, dry_run=False)
    assert sorted(r["id"] for r in done.candidates.collect()) == ["", "a", "b", "c"]
    assert done.report.first()["deleted"] == 3 and done.store.count() == 2


def test_batches_with_equal_positions_get_their_own_ids(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text(json.dumps({"user_id": "u", "pos": 0, "data": json.dumps({"memory": f"text {i}"})}) + "\n")
    items = spark.readStream.schema("user_id string, pos long, data string").option("maxFilesPerTrigger", 1).json(str(source))
    target = str(tmp_path / "out")
    (ingest.import_stream(items, target, f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(f"{target}/records").collect()
    assert len(got) == 2 and len({r["id"] for r in got}) == 2


def test_a_taken_version_is_left_alone(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([("a", "u", "t")], "id string, user_id string, memory string")
    assert tables.write_snapshot(df, root) == 1
    (tmp_path / "snap" / "version=2").mkdir()  # another job is writing
    assert tables.write_snapshot(df, root) == 3
    assert tables.snapshot_versions(spark, root) == [1, 3]
