"""Every operator over rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import public_tokenizers
import pytest

from factstore.llm import (automaton, decontaminate, fingerprints, langid, sharding, simhash, token_counts, token_files,
                           toxicity)

LONG = ("Lange Wörter und " * 15_000) + "x" * 50_000
TEXTS = [None, "", " \n\t ", "a", "The same text, twice over and over again.", "The same text, twice over and over again.",
         "Über allen Gipfeln ist Ruh", "!!! ??? 123", "tail  <|endoftext|> of　text\x00", LONG]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score string, n_tokens string, "
          "kept_id string, `window` string, held_out string, digest string, part string, shard string, ids string, items string")


@pytest.fixture(scope="module")
def vocabulary():
    return automaton.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def rows():
    out = [(i, t, None if i == 3 else "de" if i % 2 else "en", "s", None, *["clash"] * 11) for i, t in enumerate(TEXTS)]
    return out + [out[4], out[4], (None, "no id", None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("1", "same text twice over and over again the same text twice", 0), ("2", None, 0),
                                  (None, "gipfeln", 0), ("3", "", 0), ("1", "gipfeln ist", 0)],
                                 "item_id string, text string, n_hit int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, None, 1), (4, 1, None), (4, 1, 1), (5, 0, 0), (6, 0, 0), (None, 1, 1), (99, 1, 1)],
                                 "doc_id bigint, quality int, toxic int")


def run(name, docs, items, labels, vocabulary, tokenizer, folder):
    if name == "bpe":
        return automaton.digests(docs, vocabulary)
    if name == "simhash":
        return simhash.near_duplicates(docs)
    if name == "decontaminate":
        return decontaminate.contamination(docs, items)
    if name == "counts":
        return token_counts.count_tokens(docs, tokenizer, f"{folder}/cache", 5)
    if name == "language":
        return langid.identify(docs)
    if name == "files":
        return token_files.read(token_files.write(docs, tokenizer, f"{folder}/files", 2))
    if name == "toxicity":
        return toxicity.score(docs, toxicity.learn(docs, labels))
    if name == "shards":
        return sharding.report(docs, 3, tokenizer)
    return fingerprints.compare(docs)


NAMES = ["bpe", "simhash", "decontaminate", "counts", "language", "files", "toxicity", "shards", "fingerprints"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_gets_its_result(docs, items, labels, vocabulary, tokenizer, tmp_path, name):
    found = run(name, docs, items, labels, vocabulary, tokenizer, tmp_path).collect()
    assert len(found) == len(rows())
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_no_rows(none, items, labels, vocabulary, tokenizer, tmp_path, name):
    assert run(name, none, items, labels, vocabulary, tokenizer, tmp_path).collect() == []


def kept(df):
    return sorted(str(r["doc_id"]) for r in df.collect())


def test_filters_keep_all_columns(docs, items, labels):
    steps = {
        "toxicity": toxicity.harmless(docs, toxicity.learn(docs, labels)),
        "language": langid.known_language(docs, langid.learn(docs)),
        "simhash": simhash.one_of_each(docs),
        "clean": decontaminate.clean(docs, items)}
    for df in steps.values():
        assert df.columns == docs.columns
        df.collect()
    assert kept(steps["language"]) == sorted(["3", "4", "4", "4", "5", "6", "8", "9", "None"])
    # Texts without words share a fingerprint; equal texts are one group.
    assert kept(steps["simhash"]) == ["0", "3", "4", "6", "7", "8", "9", "None"]
    assert kept(steps["clean"]) == sorted(["0", "1", "2", "3", "4", "4", "4", "5", "7", "8", "9", "None", "None"])


def test_empty_models(none, labels, docs):
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(none)).collect()} == {"und"}
    scores = {r["score"] for r in toxicity.score(docs, toxicity.learn(none, labels)).collect()}
    assert len(scores) == 1


def test_no_items(docs, items):
    found = decontaminate.contamination(docs, items.limit(0)).collect()
    assert {r["contaminated"] for r in found} == {False} and len(found) == len(rows())
