import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factstore.operators import cells, embed, lexical, search, sizing, vector_index
from factstore.plans import catalog, inputs

RNG = np.random.default_rng(5)


def make_store(spark, n=400, dims=8, text_ids=False):
    rows = []
    for i in range(n):
        # Half of all rows lie in one namespace, and every tenth vector is a copy.
        user = "hot" if i % 2 else f"u{i % 7}"
        vector = RNG.standard_normal(dims) if i % 10 else np.ones(dims)
        rows.append((f"m{i:04}" if text_ids else i, user, [float(x) for x in vector]))
    kind = "string" if text_ids else "long"
    rows.append(("zz" if text_ids else 10_000, "hot", None))
    rows += [("zy" if text_ids else 9_000, "hot", [0.0] * dims), ("zz0" if text_ids else 9_001, "hot", [0.0] * dims)]
    for i, size in enumerate((dims - 1, dims + 3)):  # left over from another model
        rows.append((f"zx{i}" if text_ids else 10_002 + i, "hot", [1.0] * size))
    return spark.createDataFrame(rows, f"id {kind}, user_id string, embedding array<float>"), rows


def unit(v):
    v = np.asarray(v, dtype=np.float32).astype(np.float64)
    return v / np.linalg.norm(v)


def brute(rows, queries, k):
    out = {}
    for qid, user, q in queries:
        scored = [(-round(float(unit(v) @ unit(q)), 12), i) for i, u, v in rows
                  if u == user and v is not None and len(v) == len(q) and any(v)]
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


def hits_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("options", [{}, {"max_query_bytes": 0, "rows_per_block": 30}])
def test_batch_search_equals_brute_force(spark, text_ids, options):
    store, rows = make_store(spark, text_ids=text_ids)
    queries = [(q, user, [float(x) for x in RNG.standard_normal(8)])
               for q, user in enumerate(["hot"] * 40 + ["u0", "u2", "u4", "nobody"])]
    queries.append((99, "hot", [1.0] * 8))
    asked = spark.createDataFrame(queries, "query_id long, user_id string, embedding array<float>")
    got = hits_of(search.search_batch(store.repartition(7), asked, 5, **options))
    want = {q: ids for q, ids in brute(rows, queries, 5).items() if ids}
    assert got == want


def test_single_search_orders_floors_and_strips(spark):
    store = spark.createDataFrame(
        [("a", "u", "x", [1.0, 0.0]), ("b", "u", "y", [0.6, 0.8]), ("c", "u", "z", [0.0, 1.0]), ("d", "v", "w", [1.0, 0.0])],
        "id string, user_id string, memory string, embedding array<float>")
    got = search.search(store, [1.0, 0.0], "u").orderBy("rank").collect()
    assert [(r["id"], r["memory"]) for r in got] == [("a", "x"), ("b", "y"), ("c", "z")]
    assert [round(r["score"], 6) for r in got] == [1.0, 0.6, 0.0]
    assert "embedding" not in got[0].asDict()
    assert [r["id"] for r in search.search(store, [1.0, 0.0], "u", min_score=0.5).orderBy("rank").collect()] == ["a", "b"]
    # The floor comes after the limit.
    assert search.search(store, [0.0, 1.0], "u", limit=1, min_score=0.9).count() == 1
    assert "score" not in search.search(store, [1.0, 0.0], "u", include_scores=False).columns
    assert search.search(store, [1.0, 0.0], "nobody").count() == 0


def clustered(rng, centers, rows, dims, spread, user="u"):
    middle = [rng.standard_normal(dims) for _ in range(centers)]
    return middle, [(i, user, [float(x) for x in middle[i % centers] + spread * rng.standard_normal(dims)]) for i in range(rows)]


def opened_share(path, opened):
    """Part of the index's files that lie in cells which were opened."""
    files = {}
    for folder, _, names in os.walk(f"{path}/rows"):
        for name in names:
            if name.endswith(".parquet"):
                files.setdefault(int(folder.rsplit("=", 1)[1]), []).append(name)
    return sum(len(files[c]) for c in set().union(*opened)) / sum(map(len, files.values()))


def test_index_search_is_exact_and_opens_few_cells(spark, tmp_path):
    rng = np.random.default_rng(11)
    middle, rows = clustered(rng, 20, 2000, 16, 0.05)
    store = spark.createDataFrame(rows, "id long, user_id string, embedding array<float>").repartition(6)
    vector_index.write_index(store, str(tmp_path / "index"), 50)
    asked = spark.createDataFrame([(q, "u", [float(x) for x in c]) for q, c in enumerate(middle[:4])] +
                                  [(99, "nobody", [1.0] * 16)], "query_id long, user_id string, embedding array<float>")
    opened = []
    found = vector_index.search_index(spark, str(tmp_path / "index"), asked, 10, opened=opened)
    assert hits_of(found) == hits_of(search.search_batch(store, asked, 10))
    assert 0 < opened_share(tmp_path / "index", opened) < 0.5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in plan and "isnotnull" in plan.lower() or "IN (" in plan or "In " in plan


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("options", [{}, {"max_query_bytes": 2000}, {"min_score": 0.4}])
def test_index_search_equals_brute_force(spark, tmp_path, text_ids, options):
    """Random vectors, copies, other sizes, zero and null vectors, several namespaces."""
    store, rows = make_store(spark, text_ids=text_ids)
    vector_index.write_index(store, str(tmp_path / "index"), 40)
    rng = np.random.default_rng(3)
    queries = [(q, user, [float(x) for x in rng.standard_normal(8)]) for q, user in enumerate(["hot"] * 20 + ["u0", "u2", "nobody", None])]
    queries += [(90, "hot", [1.0] * 8), (91, "hot", [1.0] * 7), (92, "hot", [0.0] * 8), (93, "hot", None), (94, "hot", [1.0] * 5)]
    asked = spark.createDataFrame(queries, "query_id long, user_id string, embedding array<float>")
    found = vector_index.search_index(spark, str(tmp_path / "index"), asked, 5, **options)
    exact = search.search_batch(store, asked, 5, options.get("min_score", 0.0))
    order = ["query_id", "rank"]
    assert found.orderBy(*order).collect() == exact.orderBy(*order).collect()


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, user_id string, embedding array<float>")
    vector_index.write_index(none, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "u", [1.0])], "query_id long, user_id string, embedding array<float>")
    assert vector_index.search_index(spark, str(tmp_path / "index"), asked).collect() == []
    vector_index.write_index(asked.withColumnRenamed("query_id", "id"), str(tmp_path / "one"))
    assert vector_index.search_index(spark, str(tmp_path / "one"), asked.limit(0)).collect() == []


def brute_duplicates(rows, threshold):
    out = {}
    usable = [(i, u, unit(v)) for i, u, v in rows if v is not None and any(v)]
    for i, u, v in usable:
        best = sorted((-round(float(v @ w), 12), j) for j, x, w in usable
                      if x == u and j < i and len(w) == len(v))
        if best and -best[0][0] >= threshold:
            out[i] = best[0][1]
    return out


@pytest.mark.parametrize("rows_per_block", [20_000, 9])
def test_near_duplicates_equal_brute_force(spark, rows_per_block):
    store, rows = make_store(spark, 300)
    got = search.near_duplicates(store, 0.85, rows_per_block=rows_per_block).collect()
    assert {r["id"]: r["match_id"] for r in got} == brute_duplicates(rows, 0.85)
    assert len(got) == len({r["id"] for r in got})


@pytest.mark.parametrize("threshold", [0.3, 0.95])
def test_near_duplicates_among_cells(spark, threshold):
    """Many cells, visited by what may be near, cut into blocks."""
    store, rows = make_store(spark, 300)
    _, more = clustered(np.random.default_rng(5), 12, 200, 8, 0.1, "near")
    rows = rows + [(20_000 + i, u, v) for i, u, v in more]
    store = spark.createDataFrame(rows, store.schema)
    for rows_per_block in (20_000, 5):
        got = search.near_duplicates(store, threshold, 20, rows_per_block).collect()
        assert {r["id"]: r["match_id"] for r in got} == brute_duplicates(rows, threshold)
        assert len(got) == len({r["id"] for r in got})


def test_few_rows_meet(spark):
    """In clustered data under a fifth of all pairs is compared, and no row goes to every cell."""
    rng = np.random.default_rng(9)
    _, rows = clustered(rng, 25, 1500, 16, 0.04)
    store = spark.createDataFrame(rows, "id long, user_id string, embedding array<float>")
    pivots = cells.fit(store, 30)
    met = cells.meeting(store, pivots, 0.95)
    assert cells.comparisons(met) < 0.2 * 1500 * 1499 / 2
    assert met.count() < 2 * 1500
    got = {r["id"]: r["match_id"] for r in search.near_duplicates(store, 0.95, 50).collect()}
    assert got == brute_duplicates(rows, 0.95)


def test_bm25_equals_the_formula(spark):
    texts = ["the red fox", "the fox and the hound", "a quiet day", "Red red RED wine", ""]
    store = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)] + [(9, "v", "red fox")],
                                  "id long, user_id string, memory string")
    queries = spark.createDataFrame([(1, "u", "red fox!"), (2, "u", "nothing here")],
                                    "query_id long, user_id string, query string")
    words = [t.lower().split() for t in texts]
    avg = np.mean([len(w) for w in words])
    want = {}
    for i, w in enumerate(words):
        score = 0.0
        for term in ("red", "fox"):
            df, tf = sum(term in x for x in words), w.count(term)
            score += np.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if score:
            want[i] = pytest.approx(score)
    got = lexical.bm25(store, queries, 100).collect()
    assert {r["id"]: r["bm25"] for r in got} == want and {r["query_id"] for r in got} == {1}
    assert lexical.bm25(store, queries, 1).count() == 1


def test_encoders(spark):
    store = spark.createDataFrame([(1, "red fox"), (2, "Fox, red!"), (3, None), (4, "blue")], "id long, memory string")
    got = {r["id"]: r["embedding"] for r in embed.embed_hash(store, 32).collect()}
    assert got[1] == got[2] and all(len(v) == 32 for v in got.values())
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and not any(got[3])

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = {r["id"]: r["embedding"] for r in embed.embed(store, factory, 2).collect()}
    assert got == {1: [7.0, 1.0], 2: [9.0, 1.0], 3: [0.0, 1.0], 4: [4.0, 1.0]}
    with pytest.raises(Exception, match="expected"):
        embed.embed(store, factory, 3).collect()


def test_text_search_end_to_end(spark):
    store = embed.embed_hash(spark.createDataFrame(
        [(1, "u", "kafka streams events"), (2, "u", "postgres stores rows"), (3, "u", "redis caches keys")],
        "id long, user_id string, memory string"), 64)
    queries = spark.createDataFrame([(1, "u", "where are rows stored in postgres")], "query_id long, user_id string, query string")
    got = search.search_text(store, queries, lambda q: embed.embed_hash(q, 64, "query"), 1).first()
    assert got["id"] == 2


@pytest.mark.parametrize("rows_per_cell", [cells.ROWS_PER_CELL, 20])
def test_cells_larger_than_an_arrow_batch(spark, rows_per_cell):
    store, rows = make_store(spark, 250, text_ids=True)
    want = search.near_duplicates(store, 0.6, rows_per_cell, rows_per_block=40).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = search.near_duplicates(store, 0.6, rows_per_cell, rows_per_block=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) and got
    assert {r["id"]: r["match_id"] for r in got} == brute_duplicates(rows, 0.6)


EMBEDDINGS = os.environ.get("FACTSTORE_TEST_SF", "/root/testdata/sf0.001")


def test_recall_of_the_registered_settings(spark, tmp_path):
    store = inputs.vectors(spark, EMBEDDINGS).cache()
    asked = store.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = hits_of(search.search_batch(store, asked, 10))
    vector_index.write_index(store, str(tmp_path / "index"), catalog.ROWS_PER_CELL)
    for options in ({}, {"max_query_bytes": 500}):
        near = hits_of(vector_index.search_index(spark, str(tmp_path / "index"), asked, 10, **options))
        assert len(exact) >= 10 and near == exact
    rows = [sorted(tuple(r) for r in q(spark, EMBEDDINGS).collect())
            for q in (catalog.near_duplicates, catalog.near_duplicates_bucketed)]
    assert rows[0] == rows[1] and rows[0]


def test_rows_travel_a_few_times_however_small_the_blocks(spark):
    """Blocks and cells copy a row to each one that it meets; their number does not follow the rows."""
    for n in (300, 1200):
        rng = np.random.default_rng(3)
        store = spark.createDataFrame([(i, "u", rng.normal(size=8).tolist()) for i in range(n)],
                                      "id long, user_id string, embedding array<float>")
        counts = sizing.block_counts(store, ["user_id"], 2, "blocks").first()
        assert counts["blocks"] == sizing.MOST_BLOCKS
        pivots = cells.fit_for(store, n // 5, 0.3)
        met = cells.meeting(store, pivots, 0.3)
        assert met.count() <= (1 + cells.MOST_VISITS) * n
        assert search._paired(met, 2).count() <= sizing.MOST_BLOCKS * (1 + cells.MOST_VISITS) * n


def test_blocks_that_would_hold_too_much_become_more(spark, monkeypatch):
    monkeypatch.setattr(sizing, "ROWS_HELD", 10)
    store = spark.range(95).select("id", F.lit("u").alias("user_id"))
    assert sizing.block_counts(store, ["user_id"], 3, "blocks").first()["blocks"] == 10
    assert sizing.block_counts(store, ["user_id"], 30, "blocks").first()["blocks"] == 4


def test_tasks_get_each_query_once(spark, tmp_path):
    """A query that opens many cells is sent with one vector, not with one for each cell."""
    store, _ = make_store(spark, 400, 16)
    vector_index.write_index(store, str(tmp_path / "index"), 10)
    asked = store.where("id % 5 = 0").withColumnRenamed("id", "query_id").select("query_id", "user_id", "embedding")
    pivots = vector_index.read_pivots(spark, str(tmp_path / "index"))
    part = vector_index._asked(spark, str(tmp_path / "index"), pivots, asked.toArrow().combine_chunks())
    every = part.open(np.full(len(part.ids), -1.0), {q: [] for q in range(len(part.ids))})
    vectors, plan = vector_index._plan(part, every, np.full(len(part.ids), -1.0))
    assert sum(map(len, every.values())) > 5 * len(part.ids)
    assert sum(len(m) for sizes in vectors.values() for _, m in sizes.values()) == len(part.ids)
    assert sum(len(at) for places, _ in plan.values() for at in places.values()) == sum(map(len, every.values()))


def test_few_rows_of_a_batch_become_doubles_at_a_time():
    batch = pa.record_batch([pa.array(range(2 * search.ROWS_PER_SLICE + 7))], ["id"])
    parts = list(search._slices([batch, batch.slice(0, 0), batch.slice(3, 5)]))
    assert [p.num_rows for p in parts] == [search.ROWS_PER_SLICE, search.ROWS_PER_SLICE, 7, 5]
    assert [i for p in parts[:3] for i in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_keyword_sums_of_a_task_do_not_follow_the_table(spark, monkeypatch):
    assert lexical._tasks(3_000_000, 200) == 1200 and lexical._tasks(0, 0) == 1 and lexical._tasks(10**6, 10**6) == lexical.MOST_TASKS
    store = spark.createDataFrame([(i, "u", f"red fox {i}") for i in range(60)], "id long, user_id string, memory string")
    queries = spark.createDataFrame([(1, "u", "red"), (2, "u", "fox 3")], "query_id long, user_id string, query string")
    want = sorted(tuple(r) for r in lexical.bm25(store, queries, 5).collect())
    monkeypatch.setattr(lexical, "SUMS_PER_TASK", 10)
    found = lexical.bm25(store, queries, 5)
    assert "hashpartitioning(id#" in (plan := found._jdf.queryExecution().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    assert sorted(tuple(r) for r in found.collect()) == want
