"""Ranked lexical search against a plain loop over items and documents."""

import math
import random
import re

import numpy as np
import pytest

from factstore.llm import lexical_ranking

DOCS = "doc_id bigint, text string, score string, item string, n string"
ITEMS = "item_id bigint, text string, rank string, term string"


def plain_terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain(docs, items, k):
    found = [(i, t) for i, t in ((i, plain_terms(t)) for i, t in docs) if t]
    n, every = len(found), sum(len(t) for _, t in found)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, words in asked.items():
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in t for _, t in found) + 1))) for w in words}
        scored = []
        for doc, own in found:
            m = 100 - 50 + (50 * len(own) * n) // every
            score = sum(weight[w] * ((1_000_000_000 * own.count(w)) // (1000 * own.count(w) + 20 * m)) for w in words if w in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "x1", "東京"]
    passage = lambda a, b: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(64)], k=rng.randint(a, b)))
    docs = [(i, passage(0, 40)) for i in range(150)]
    docs += [(200, docs[3][1]), (200, docs[3][1]), (201, docs[3][1].upper()), (None, docs[4][1]), (202, None), (203, ""), (204, " \n-!"),
             (205, "w1 " * 30_000 + "y" * 100_000), (206, "W1,w1\tw2'w3\x85x")]
    shared = passage(8, 12)
    items = [(i, f"{shared if i % 3 else ''} {passage(1, 15)}") for i in range(40)]
    items += [(50, None), (51, "???"), (52, "nowhere at all"), (53, items[1][1]), (None, "w5 w6"), (1, "w7 w9"), (1, "w7 w9")]
    return docs, items


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(*r, "clash", "clash") for r in items], ITEMS).repartition(2)
    return sorted((tuple(r) for r in lexical_ranking.rank(d, i, **more).collect()), key=repr)


@pytest.mark.parametrize("k, block_bytes", [(50, lexical_ranking.BLOCK_BYTES), (3, 2000)])
def test_ranking(spark, tables, monkeypatch, k, block_bytes):
    monkeypatch.setattr(lexical_ranking, "TASK_GROUPS", 2)
    assert ranked(spark, *tables, k=k, block_bytes=block_bytes) == plain(*tables, k)


def test_small_groups_of_items(spark, tables, monkeypatch):
    monkeypatch.setattr(lexical_ranking, "MINED_TOGETHER", 7)
    monkeypatch.setattr(lexical_ranking, "CELLS", 500)
    assert ranked(spark, *tables, k=10) == plain(*tables, 10)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, docs[-3:-2], [(1, None)]) == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    found = lexical_ranking.rank(docs, items).orderBy("rank").collect()
    assert [(r["item_id"], r["doc_id"]) for r in found] == [("i", None), ("i", "a"), ("i", "b")]


def test_shared_sums():
    rng = np.random.default_rng(3)
    common = [rng.choice(200, 20, replace=False) for _ in range(5)]
    sets = [np.unique(np.concatenate([*(common[j] for j in rng.choice(5, rng.integers(0, 4), replace=False)), rng.choice(200, 6)]))
            for _ in range(60)] + [np.zeros(0, np.int64)]
    shared = lexical_ranking.Shared(sets, 200)
    values = rng.integers(1, 1 << 40, (200, 3))
    at, column = np.divmod(np.arange(600), 3)
    got = shared.scores(at, column, values.ravel(), 3)
    assert (got == np.array([values[s].sum(0) for s in sets])).all()
    assert shared.nodes and shared.additions < 0.6 * sum(len(s) for s in sets)


def test_lengths_beyond_64_bits():
    n = np.array([1, 10 ** 9, 3 * 10 ** 9])
    found = lexical_ranking._lengths(n, 10 ** 12, 10 ** 15)
    assert found.tolist() == [50 + 50 * int(x) * 10 ** 12 // 10 ** 15 for x in n]
