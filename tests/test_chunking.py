import json
import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factstore.functions.chunking import chunk_text, fold_words, split_words
from factstore.operators.chunks import (
    add_facts, add_verbatim, chunk_documents, chunk_report, document_report, document_status, import_documents,
    plan_import)
from factstore.functions.text import record_id


def test_golden_chunks(one):
    texts = ["Red kites.\n\nBlue tits.\n\nGreen finches."]
    assert one(texts, chunk_text("c", 25)) == [["Red kites.\n\nBlue tits.", "Green finches."]]
    assert one(["tiny"], chunk_text("c", 100)) == [["tiny"]]
    assert one(["tiny"], chunk_text("c", 100, F.lit("[Document: f]"))) == [["[Document: f]\n\ntiny"]]
    assert one(["a" * 50], chunk_text("c", 10)) == [["a" * 10] * 5]
    assert one(["x" * 1000], chunk_text("c", 1000)) == [["x" * 1000]]
    headed = one(["a" * 990], chunk_text("c", 1000, F.lit("[Document: f]X")))[0]
    assert len(headed) > 1 and all(len(p) <= 1000 for p in headed)


def test_pending_text_before_a_long_paragraph(one):
    text = "aaa\n\n" + "b" * 50
    assert one([text], chunk_text("c", 10)) == [["aaa"] + ["b" * 10] * 5 + ["aaa"]]
    assert one([text], chunk_text("c", 10, compat=False)) == [["aaa"] + ["b" * 10] * 5]


def test_pieces_of_a_long_line_around_a_pending_line(one):
    text = "short\n" + "c" * 25 + "\nend"
    assert one([text], chunk_text("c", 10)) == [["c" * 10, "c" * 10, "c" * 5, "short\nend"]]
    assert one([text], chunk_text("c", 10, compat=False)) == [["short", "c" * 10, "c" * 10, "c" * 5, "end"]]


def test_header_as_long_as_the_limit(one):
    assert one(["t" * 30], chunk_text("c", 10, F.lit("h" * 8))) == [None]


def test_words_and_astral_characters(one):
    assert one(["one two three four"], chunk_text("c", 9)) == [["one two", "three", "four"]]
    assert one(["😀a" * 6], chunk_text("c", 5)) == [["😀a😀a😀", "a😀a😀a", "😀a"]]


def test_very_long_word(one):
    pieces = one(["😀a" * 100_000], chunk_text("c", 50_000))[0]
    assert [len(p) for p in pieces] == [50_000] * 4


def test_texts_of_many_blocks(one):
    line = "abcdefghi"
    ten_lines, ten_words, ten_paragraphs = "\n".join([line] * 10), " ".join([line] * 10), "\n\n".join([line] * 10)
    assert one(["\n".join([line] * 3000)], chunk_text("c", 100)) == [[ten_lines] * 300]
    assert one(["\n\n".join([line] * 3000)], chunk_text("c", 109)) == [[ten_paragraphs] * 300]
    long_line = " ".join([line] * 3000)
    assert one([long_line], fold_words(F.col("c"), F.lit(100))) == [[ten_words] * 300]
    assert one([long_line], split_words(F.col("c"), F.lit(100))) == [[ten_words] * 300]
    # A paragraph over the limit in each of many blocks keeps the pieces in order.
    paragraphs = [f"p{i} " + "x" * 20 for i in range(2500)]
    got = one(["\n\n".join(paragraphs)], chunk_text("c", 12, compat=False))[0]
    assert [g for g in got if g.startswith("p")] == [f"p{i}" for i in range(2500)]


def solid(text):
    return text.replace(" ", "").replace("\n", "")


words = st.text(alphabet="ab é😀\n", max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(words, min_size=10, max_size=40), st.integers(3, 20))
def test_chunks_are_bounded_and_whole(one, texts, limit):
    for compat in (True, False):
        for text, chunks in zip(texts, one(texts, chunk_text("c", limit, compat=compat))):
            assert all(len(p) <= limit for p in chunks)
            if not compat:
                assert solid("".join(chunks)) == solid(text)


lines = st.text(alphabet="ab  é😀\r", min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(lines, min_size=20, max_size=60), st.integers(1, 20))
def test_word_pattern_equals_the_word_fold(one, texts, limit):
    texts = [t for t in texts if len(t) > limit] + ["x" * (limit + 1)]
    assert one(texts, split_words(F.col("c"), F.lit(limit))) == one(texts, fold_words(F.col("c"), F.lit(limit)))


def requests(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)],
                                 "request_id string, content string, user_id string, metadata string")


def by_request(df):
    out = {}
    for r in df.orderBy("request_id", "pos").collect():
        out.setdefault(r["request_id"], []).append(r)
    return out


def test_verbatim_ingest(spark):
    long_pair = "k9 " + "m" * 55 + "\n\n" + "z4 " + "n" * 55
    rows, failed = add_verbatim(requests(spark, [
        ("b" * 3000, "u", '{"a": 1}'), ("b" * 3001, None, None),
        ("b" * 3001, "u", '{"file":"doc.md","source":"src-9","n":5}'), ("  \n", "u", None), (None, "u", None)]))
    got = by_request(rows)
    assert [(r["memory"], r["metadata"]) for r in got["0"]] == [("b" * 3000, '{"a": 1}')]
    assert [(len(r["memory"]), json.loads(r["metadata"]), r["user_id"]) for r in got["1"]] == [
        (3000, {"chunk": "1/2"}, "dev"), (1, {"chunk": "2/2"}, "dev")]
    assert all(r["memory"].startswith("[Document: doc.md] [Source: src-9]\n\n") for r in got["2"])
    assert json.loads(got["2"][0]["metadata"]) == {"file": "doc.md", "source": "src-9", "n": 5, "chunk": "1/2"}
    assert {(r["request_id"], r["error_code"], r["message"]) for r in failed.collect()} == {
        ("3", "empty_content", "Cannot save empty content."), ("4", "content_required", "content is required.")}

    rows, _ = add_verbatim(requests(spark, [(long_pair, "u", '{"file": "f"}')]), max_chars=60)
    got = by_request(rows)["0"]
    assert [len(r["memory"]) for r in got] == [17, 60, 25, 17, 60, 25]
    assert [json.loads(r["metadata"])["chunk"] for r in got] == [f"{i}/6" for i in range(1, 7)]


def test_text_over_the_limit_is_tagged_even_as_one_chunk(spark):
    rows, _ = add_verbatim(requests(spark, [("a" * 9 + "\n\n", "u", None)]), max_chars=10)
    assert [(r["memory"], r["metadata"]) for r in rows.collect()] == [("a" * 9, '{"chunk":"1/1"}')]


def test_header_too_long_is_a_reject(spark):
    rows, failed = add_verbatim(requests(spark, [("t" * 50, "u", json.dumps({"file": "f" * 40}))]), max_chars=20)
    assert rows.count() == 0
    assert [r["error_code"] for r in failed.collect()] == ["header_too_long"]


def test_facts_are_bounded_by_stripped_length(spark):
    rows, failed = add_facts(requests(spark, [
        ("  " + "b" * 3000 + " ", "u", None), (" " + "b" * 3001, "u", None), ("ok", None, None)]))
    assert {r["request_id"] for r in rows.collect()} == {"0", "2"}
    bad = failed.collect()
    assert len(bad) == 1 and "3002 chars (limit 3000)" in bad[0]["message"] and bad[0]["error_code"] == "too_long"


def docs(spark, rows):
    return spark.createDataFrame([(f, t, len(t.encode())) for f, t in rows], "file string, text string, n_bytes long")


def test_document_import_and_reports(spark):
    table = docs(spark, [("a.md", "x" * 49), ("b.md", "y" * 60), ("c/d.md", ("line of text\n" * 40)),
                         ("l" * 200 + ".md", "z" * 300)])
    rows = import_documents(table, "proj", chunk_chars=200, store_chars=200)
    got = rows.orderBy("file", "part").collect()
    assert {r["file"] for r in got} == {"b.md", "c/d.md"}
    assert got[0]["memory"] == "[Document: b.md][Source: docs_import]\n\n" + "y" * 60
    assert json.loads(got[0]["metadata"]) == {"file": "b.md", "repo": "proj", "source": "docs_import"}
    tagged = [json.loads(r["metadata"])["chunk"] for r in got[1:]]
    assert len(tagged) > 1 and tagged == [f"{i}/{len(tagged)}" for i in range(1, len(tagged) + 1)]
    assert len({r["id"] for r in got}) == len(got)
    status = document_status(table, 200)
    assert {r["file"][:5]: r["status"] for r in status.collect()} == {
        "a.md": "skipped", "b.md": "imported", "c/d.m": "imported", "lllll": "failed"}
    assert document_report(status).first().asDict() == {"imported": 2, "failed": 1, "skipped": 1, "total": 4}


def test_dry_run_counts_without_header(spark):
    plan = plan_import(docs(spark, [("a.md", "x" * 10), ("b.md", "é" * 25)]), 10).orderBy("file").collect()
    assert [(r["file"], r["n_bytes"], r["n_chunks"]) for r in plan] == [("a.md", 10, 1), ("b.md", 50, 3)]


def test_importer_chunks_above_the_store_limit_are_packed_again(spark):
    table = docs(spark, [("a.md", "w" * 180)])
    rows = import_documents(table, "p", chunk_chars=150, store_chars=100).orderBy("part", "pos").collect()
    assert all(len(r["memory"]) <= 100 for r in rows)
    first = rows[0]
    assert first["memory"].startswith("[Document: a.md] [Source: docs_import]\n\n")
    assert json.loads(first["metadata"])["chunk"].startswith("1/")
    assert {json.loads(r["metadata"])["chunk"] for r in rows if r["part"] == 1} == {"2/2"} or len(rows) > 2


def test_chunk_report_keeps_order(spark):
    rows, _ = add_verbatim(requests(spark, [("b" * 25, "u", None)]), max_chars=10)
    rows = rows.withColumn("id", record_id("request_id", "pos"))
    report = chunk_report(rows).first()
    in_order = [r["id"] for r in rows.orderBy("pos").collect()]
    assert report["chunks"] == 3 and report["results"] == in_order
    assert chunk_documents(docs(spark, []), "p").count() == 0


def test_both_word_packers_agree_around_the_switch(one):
    """The limit at which packing changes its implementation changes no chunk."""
    rng = random.Random(21)
    words = ["w" * n for n in (1, 7, 300, 8191, 8192, 8193, 20_000)] + ["", "", "\U0001F600" * 40, "é́"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(12)]
    texts += ["a" * 8192 + " " + "b" * 8192, " " * 9000 + "x", "\U0001F600" * 9000]
    for limit in (8191, 8192, 8193, 8200):
        assert one(texts, split_words(F.col("c"), F.lit(limit))) == one(texts, fold_words(F.col("c"), F.lit(limit)))
