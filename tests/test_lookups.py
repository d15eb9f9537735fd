"""Lookups by id and far pages open little of a stored table."""

import pytest
from pyspark.sql import functions as F

from factstore.operators import mutate, records
from factstore.sources import tables


def rows_read(df):
    """Rows that the scans of an executed plan gave out."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            plan.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            plan.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total


def make(spark, n=6000):
    ids = F.sha2(F.col("id").cast("string"), 256)  # ids without an order, as digests are
    return spark.range(n).select(ids.alias("id"), F.concat(F.lit("text "), "id").alias("memory"),
                                 F.concat(F.lit("u"), F.col("id") % 3).alias("user_id"))


def small_groups(spark):
    """Row groups of about a hundred rows stand for those of a large table."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "4096")
    return lambda: conf.unset("parquet.block.size")


def test_few_ids_open_few_row_groups(spark, tmp_path):
    undo = small_groups(spark)
    try:
        tables.append(make(spark), str(tmp_path / "t"), buckets=2)
    finally:
        undo()
    store = tables.scan(spark, str(tmp_path / "t"))
    ids = make(spark).where("memory IN ('text 7', 'text 4711')").select("id").union(spark.createDataFrame([("none",)], "id string"))
    found = records.of_ids(store, ids)
    assert rows_read(found) < 600
    assert sorted(r["memory"] for r in found.collect()) == ["text 4711", "text 7"]
    got = {r["id"]: (r["found"], r["memory"]) for r in tables.find(spark, str(tmp_path / "t"), ids.withColumnRenamed("id", "memory_id")).collect()}
    assert got["none"] == (False, None) and sorted(m for f, m in got.values() if f) == ["text 4711", "text 7"]


def test_many_ids_give_the_same(spark, monkeypatch):
    store = make(spark, 300)
    asked = store.where("user_id = 'u1'").select("id").union(spark.createDataFrame([(None,), ("x",)], "id string"))
    want = sorted(r["id"] for r in store.where("user_id = 'u1'").collect())
    for most in (1000, 3):
        monkeypatch.setattr(records, "MAX_PUSHED_IDS", most)
        assert sorted(r["id"] for r in records.of_ids(store, asked).collect()) == want
        left, failed = mutate.delete_memories(store, asked.withColumnRenamed("id", "memory_id"))
        assert left.count() == 200 and sorted(str(r["memory_id"]) for r in failed.collect()) == ["None", "x"]
    monkeypatch.undo()
    assert records.of_ids(store, asked.limit(0)).count() == 0


def test_far_pages_read_one_range(spark, tmp_path):
    when = F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("id") * 7 % 60).cast("string"), 2, "0"))
    df = spark.range(3000).select(
        F.concat(F.lit("m"), F.col("id")).alias("id"), F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("hot").alias("user_id"),
        F.when(F.col("id") % 11 > 0, when).alias("created_at"))
    tables.write_listing(df.repartition(5), str(tmp_path / "l"), 100)
    for limit, page in ((10, 1), (10, 100), (170, 3), (7, 500), (100, 24)):
        want = [r["id"] for r in records.page(df, "hot", limit, page).collect()]
        got = tables.listing_page(spark, str(tmp_path / "l"), "hot", limit, page)
        assert [r["id"] for r in got.orderBy("position").collect()] == want
        every = records.page(df, None, limit, page).select("user_id", "position", "id")
        each = tables.listing_page(spark, str(tmp_path / "l"), None, limit, page).select("user_id", "position", "id")
        assert sorted(map(tuple, each.collect())) == sorted(map(tuple, every.collect()))
    far = tables.listing_page(spark, str(tmp_path / "l"), "hot", 10, 150)
    assert 0 < rows_read(far) <= 250  # of 3000, one range or two
    assert tables.listing_page(spark, str(tmp_path / "l"), "nobody").count() == 0
    with pytest.raises(ValueError):
        tables.listing_page(spark, str(tmp_path / "l"), "hot", 0)


def test_ranges_of_a_listing_are_cut_by_few_tasks(spark, tmp_path):
    """The driver samples for each task, so the tasks must not follow the number of small ranges."""
    assert tables._listing_tasks(3_000_000, 100) == 600 and tables._listing_tasks(10**9, 100) == tables.MOST_TASKS
    df = spark.range(500).selectExpr("concat('r', id) AS id", "'u' AS user_id", "cast(1500000000 + id * 7 % 90 AS string) AS created_at")
    tables.write_listing(df, str(tmp_path / "l"), 10)
    held = spark.read.parquet(str(tmp_path / "l" / "ranges")).collect()
    assert len(held) == 50 and {r["n"] for r in held} == {10}
    rows = spark.read.parquet(str(tmp_path / "l" / "rows"))
    assert [p.name for p in (tmp_path / "l" / "rows").glob("part=*")] == ["part=0"]
    assert len(rows.inputFiles()) == 1
    got = [r["id"] for r in tables.listing_page(spark, str(tmp_path / "l"), "u", 30, 4).orderBy("position").collect()]
    assert got == sorted((f"r{i}" for i in range(500)), key=lambda r: (int(r[1:]) * 7 % 90, r))[90:120]
