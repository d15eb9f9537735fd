import json

import pytest
from pyspark.sql import functions as F

from factstore.operators import audit, mutate, records, validate
from factstore.schema import DEFAULT_USER_ID


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_entities(spark):
    rows = [("alice", None, None, None), (None, "agent-7", "", None), ("alice", None, "app", "run")]
    df = table(spark, rows, "user_id string, agent_id string, app_id string, run_id string")
    assert [r["entity"] for r in records.list_entities(df).collect()] == ["agent-7", "alice", "app", "run"]
    assert records.list_entities(df.where("false")).collect() == []
    stats = records.listing_stats(df).first()
    assert (stats["memories"], stats["entities"]) == (3, 1)
    assert records.listing_stats(df.where("false")).first().asDict() == {"memories": 0, "entities": 0}


def test_flatten_payload(spark):
    rows = [("1", '{"data":"d","memory":"m","user_id":"u","created_at":"2020","n":1,"b":true,"agent_id":"a"}'),
            ("2", '{"memory":"","text":"t"}'), ("3", None), ("4", '{"text":"t","embedding":[1],"text_lemmatized":"x"}')]
    got = records.flatten_payload(table(spark, rows, "id string, payload string")).orderBy("id").collect()
    assert [(r["memory"], r["user_id"], r["created_at"]) for r in got] == [
        ("d", "u", "2020"), ("", "", ""), ("", "", ""), ("t", "", "")]
    assert json.loads(got[0]["metadata"]) == {"n": 1, "b": True, "agent_id": "a"}
    assert got[0]["agent_id"] == "a" and got[3]["metadata"] == "{}"


def test_grep_covers_every_field(spark):
    rows = [("A1", "Fact One", "u", '{"Tag":"x"}', None), ("B2", "two", "Owner", None, "2020-01-01")]
    df = table(spark, rows, "id string, memory string, user_id string, metadata string, created_at string")

    def ids(q):
        return [r["id"] for r in records.grep_records(df, q).orderBy("id").collect()]

    assert ids("fact one") == ["A1"] and ids('TAG":"X') == ["A1"] and ids("owner") == ["B2"]
    assert ids("2020-01") == ["B2"] and ids("") == ["A1", "B2"] and ids("nowhere") == []


def test_lookup_and_delete(spark):
    store = table(spark, [("1", "a", "u"), ("2", "b", "u"), ("3", "c", "v")], "id string, memory string, user_id string")
    ids = table(spark, [("1",), ("9",), ("",), (None,), ("1",)], "memory_id string")
    got = {r["id"]: (r["found"], r["message"]) for r in records.lookup(store, ids).collect()}
    assert got == {"1": (True, None), "9": (False, "Failed to retrieve memory '9'.")}
    left, failed = mutate.delete_memories(store, ids)
    assert sorted(r["id"] for r in left.collect()) == ["2", "3"]
    assert sorted(r["error_code"] for r in failed.collect()) == ["id_required", "id_required", "unknown_id"]
    assert [r["id"] for r in mutate.delete_namespace(store, "u").collect()] == ["3"]
    assert mutate.delete_namespace(store).count() == 3 and DEFAULT_USER_ID == "dev"
    assert mutate.delete_entity(store, "v").count() == 2
    with pytest.raises(ValueError, match="user_id is required"):
        mutate.delete_entity(store, "")
    gone = table(spark, [("u",), ("u",)], "user_id string")
    assert [r["id"] for r in mutate.anti_by(store, gone, "user_id").collect()] == ["3"]


def test_update_takes_the_last_text_and_drops_the_old_vector(spark):
    store = table(spark, [("1", "a", "u", [1.0]), ("2", "b", "u", [2.0])],
                  "id string, memory string, user_id string, embedding array<float>")
    updates = table(spark, [("1", "first", 0), ("1", "second", 1), ("2", "  ", 2), ("7", "x", 3), ("", "y", 4)],
                    "memory_id string, content string, pos int")
    after, failed = mutate.update_memories(store, updates)
    assert {r["id"]: (r["memory"], r["embedding"]) for r in after.collect()} == {
        "1": ("second", None), "2": ("b", [2.0])}
    assert sorted(r["error_code"] for r in failed.collect()) == ["empty_content", "id_required", "unknown_id"]
    encode = lambda df: df.withColumn("embedding", F.array(F.length("memory").cast("float")))
    after, _ = mutate.update_memories(store, updates, encode)
    assert {r["id"]: r["embedding"] for r in after.collect()} == {"1": [6.0], "2": [2.0]}


def test_export_records_defaults(spark):
    df = table(spark, [("", "m1", "t", None, None, None), ("i", None, None, "{}", "2020", "bob")],
               "id string, memory_id string, memory string, metadata string, created_at string, user_id string")
    got = [tuple(r) for r in records.export_records(df, "req").orderBy("id").collect()]
    assert got == [("i", "", "{}", "2020", "bob"), ("m1", "t", "{}", "", "req")]


def test_score_floor_and_columns(spark):
    df = table(spark, [("a", 0.9), ("b", 0.2), ("c", None)], "id string, score double")

    def ids(m):
        return [r["id"] for r in records.score_floor(df, m).orderBy("id").collect()]

    assert ids(0.5) == ["a", "c"] and ids(0) == ids(None) == ["a", "b", "c"]
    assert records.with_scores(df, False).columns == ["id"]
    assert records.with_scores(df.drop("score")).first()["score"] is None


def test_pages(spark):
    rows = [(f"m{i:02}", u, f"2020-01-{i + 1:02}") for u in ("u", "v") for i in range(7)]
    df = table(spark, rows, "id string, user_id string, created_at string")
    assert [r["id"] for r in records.page(df, "u", 3, 2).collect()] == ["m03", "m04", "m05"]
    assert [r["id"] for r in records.page(df, "u", 3, 3).collect()] == ["m06"]
    every = records.page(df, None, 3, 3).orderBy("user_id").collect()
    assert [(r["user_id"], r["id"], r["position"]) for r in every] == [("u", "m06", 7), ("v", "m06", 7)]
    with pytest.raises(ValueError):
        records.page(df, "u", 0)
    assert records.list_namespace(df, "u", 4).count() == 4


def test_cards(spark):
    df = table(spark, [("0123456789abcdef", "a<b", None, None, 0.12345), ("x", "", "", "2020", None)],
               "id string, memory string, user_id string, created_at string, score double")
    got = {r["short_id"]: tuple(r) for r in records.listing_cards(df).collect()}
    assert got == {"0123456789ab": ("a&lt;b", "-", "0123456789ab", "-", "0.123"), "x": ("", "-", "x", "2020", "")}


NOW = 1_700_000_000.0


def prune_rows(spark, rows):
    return table(spark, rows, "id string, memory string, created_at string, score double")


def test_prune_dates(spark):
    df = prune_rows(spark, [(str(i), "m", c, None) for i, c in enumerate([
        "2020-01-01T00:00:00", "2020-01-01T00:00:00Z", "0.0", "2020-01-01", "not a date", None,
        str(NOW + 5), str(NOW - 86400)])] + [("", "no id " * 100, "2020-01-01", None)])
    dry = mutate.prune(df, NOW)
    assert dry.report.first().asDict() == {"would_delete": 5, "deleted": 0, "dry_run": True}
    assert dry.store.count() == 9
    assert max(len(r["memory"]) for r in dry.candidates.collect()) == 200
    wet = mutate.prune(df, NOW, dry_run=False)
    assert wet.report.first().asDict() == {"would_delete": 5, "deleted": 4, "dry_run": False}
    assert sorted(r["id"] for r in wet.store.collect()) == ["", "4", "5", "6", "7"]


def test_prune_floor(spark):
    df = prune_rows(spark, [(str(s), "m", "2020-01-01", s) for s in (0.9, 0.5, 0.3, None)])

    def kept(m):
        return {r["score"] for r in mutate.prune(df, NOW, dry_run=False, min_score=m).store.collect()}

    assert kept(0.5) == {0.9, 0.5, None} and kept(0) == {0.9, 0.5, 0.3, None} and kept(None) == set()
    # Without a score column nothing was ever rated, so a floor keeps everything.
    assert mutate.prune(df.drop("score"), NOW, dry_run=False, min_score=0.5).store.count() == 4


def test_prune_cutoff_is_strict(spark):
    cut = NOW - 2 * 86400
    df = prune_rows(spark, [(str(d), "m", f"{cut + d:.1f}", None) for d in (-5, 0, 5)])
    got = mutate.prune(df, NOW, days=2, dry_run=False).store.collect()
    assert sorted(r["id"] for r in got) == ["0", "5"]


def test_prune_one_namespace(spark):
    df = table(spark, [("1", "m", "2020", "u"), ("2", "m", "2000-01-01", "u"), ("3", "m", "2000-01-01", "v")],
               "id string, memory string, created_at string, user_id string")
    got = mutate.prune(df, NOW, dry_run=False, user_id="u").store.collect()
    assert sorted(r["id"] for r in got) == ["3"]  # "2020" is an epoch


def test_dimension_audit(spark):
    ok = table(spark, [([1.0, 2.0],), (None,)], "embedding array<float>")
    mixed = table(spark, [([1.0, 2.0],), ([1.0],)], "embedding array<float>")
    empty = ok.where("false")
    got = {(r["collection"], r["dim"]): r["action"] for r in audit.audit_dims(
        {"a": ok, "b": mixed, "c": empty}, 2).collect()}
    assert got == {("a", 2): "a OK (2)", ("b", 2): "b OK (2)", ("b", 1): "b mismatch (was 1)"}
    assert audit.enforce_dims({"a": ok}, 2)["a"] is ok
    with pytest.raises(audit.DimensionMismatch, match="1 rows of 1 other sizes"):
        audit.enforce_dims({"b": mixed}, 2)
    assert audit.enforce_dims({"b": mixed}, 2, "drop")["b"].count() == 1
    with pytest.raises(ValueError):
        audit.enforce_dims({"b": mixed}, 2, "other")


def test_collection_settings(one):
    got = one(['{"size": 768, "distance": "Cosine"}', '{"named": {"size": 768}, "meta": "no"}', "{}",
               '[{"name":"n","size":768}]', "junk", None], audit.config_dims("c"))
    assert got == [768, 768, None, None, None, None]


def test_request_checks(spark):
    df = table(spark, [("q",), (" ",), (None,)], "query string")
    assert [r["error_code"] for r in validate.validate_queries(df).collect()] == [None, "empty_query", "empty_query"]
    ids = table(spark, [("x",), ("",), (None,)], "user_id string")
    assert [r["message"] for r in validate.validate_ids(ids, "user_id").collect()] == [
        None, "user_id is required.", "user_id is required."]
    batches = table(spark, [("u", "[1]"), (" ", "[1]"), ("u", ""), ("u", "{"), ("u", "{}"), ("u", "[]")],
                    "user_id string, data string")
    assert [r["error_code"] for r in validate.validate_batches(batches).collect()] == [
        None, "user_required", "data_required", "invalid_json", "not_an_array", "empty_batch"]
    with pytest.raises(ValueError, match="Use 'json' or 'csv'"):
        validate.check_export_format("xml")
    with pytest.raises(ValueError):
        validate.validate_add(df, "other")
