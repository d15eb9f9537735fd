"""Whole results of earlier operators against plain versions, and the pipeline's filters on an empty table."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from factstore.llm import decontaminate, langid, sharding, simhash, token_counts, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, extra string"


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.read_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.no_padding()
    own.no_truncation()
    return own


def texts(seed, n):
    rng = random.Random(seed)
    atoms = ["the ", "of", " and", "ing", "\n", "  ", "é", "東京", "<|endoftext|>", "!!", " 12", "'s", "\x00", "x" * 30]
    return ["".join(rng.choices(atoms, k=rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "a" * 5000]


def test_filters_on_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([("i", "some words of an item")], "item_id string, text string")
    for kept in (toxicity.harmless(none, toxicity.learn(none, labels)), langid.known_language(none, langid.learn(none)),
                 simhash.one_of_each(none), decontaminate.clean(none, items)):
        assert kept.columns == none.columns and kept.collect() == []


def test_ranks_give_the_ids_of_the_library(tokenizer, library):
    assert token_counts.merges_by_id(tokenizer)
    some = [t or "" for t in texts(1, 3000)]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    for ranked in (True, False):
        coder = token_counts.library_coder(tokenizer[1], ranked)
        found = []
        for at in range(0, len(some), 500):
            found += [np.frombuffer(x, "<u4").tolist() for x in coder.encode(some[at:at + 500])]
        assert found == want


def test_ranks_are_not_taken_where_merges_differ():
    spec = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False,
            "use_regex": True, "trim_offsets": True}, "normalizer": None, "added_tokens": [], "version": "1.0"}
    from json import dumps

    from factstore.llm.segments import byte_chars

    spec["model"]["vocab"] = {c: i for i, (_, c) in enumerate(byte_chars())}
    for extra, merges, good in ((["ab", "abc"], ["a b", "ab c"], True), (["abc", "ab"], ["a b", "ab c"], False),
                                (["ab", "bc", "abc"], ["a b", "b c", "a bc"], False), (["ab", "xyz"], ["a b"], False)):
        spec["model"]["vocab"] = {c: i for i, (_, c) in enumerate(byte_chars())} | {t: 256 + i for i, t in enumerate(extra)}
        spec["model"]["merges"] = merges
        assert token_counts.merges_by_id((".json", dumps(spec).encode())) is good, merges


def test_token_files_hold_what_the_library_gives(spark, tokenizer, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "TOKENS_PER_FILE", 300)
    rows = [(i * 7 % 1009, t, "de", "x") for i, t in enumerate(texts(2, 200))] + [(None, "no id", None, None), (14, "again", None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = token_files.read(token_files.write(docs, tokenizer, str(tmp_path / "files"), 2)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc, text, *_ in order:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        want.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=lambda r: r[1])
    assert got == want


def test_an_encoded_text_is_not_encoded_again(spark, tokenizer, tmp_path, monkeypatch):
    """Repeated rows and copies are one entry of the cache, and a later run adds only what is new."""
    rows = [(1, "same text", "", ""), (1, "same text", "", ""), (2, "same text", "", ""), (None, "other", "", ""), (None, "other", "", ""),
            (3, None, "", ""), (4, "", "", "")]
    cache = str(tmp_path / "cache")
    first = token_counts.count_tokens(spark.createDataFrame(rows, DOCS), tokenizer, cache, 1)
    assert first.count() == 7 and spark.read.parquet(cache).count() == 3
    more = rows + [(5, "new", "", ""), (6, "new", "", "")]
    for few in (True, False):
        monkeypatch.setattr(token_counts, "is_small", lambda df, few=few: few)
        assert token_counts.count_tokens(spark.createDataFrame(more, DOCS).repartition(3), tokenizer, cache, 1).count() == 9
        assert spark.read.parquet(cache).count() == 4


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_documents(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(30)]
    made = base + [t.replace("w7", "W7", 1) for t in base[:10]] + [t + " tail" for t in base[:15]] + base[:5] + [None, "", " \n"]
    rows = [(i * 13 % 997, t, "", "") for i, t in enumerate(made)]
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    label = [r[0] for r in rows]
    while True:
        new = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    found = {tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, label)}


def plain_ftrl(rows):
    """Per-coordinate FTRL-proximal, one feature at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for places, label in rows:
            at = [*places.tolist(), "bias"]
            weights = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weights.values())))))
            g = p - label
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * weights[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_learning_is_ftrl_proximal():
    rng = random.Random(3)
    bad, good = [f"bad{i}" for i in range(5)], [f"word{i}" for i in range(40)]
    rows = []
    for k in range(150):
        own = rng.choices(good, k=15) + (rng.choices(bad, k=3) if k % 3 == 0 else [])
        rows.append((np.unique(toxicity.features(" ".join(own))).astype("<i4"), int(k % 3 == 0)))
    places, values, bias = toxicity.fit(rows)
    want = plain_ftrl(rows)
    assert bias == pytest.approx(want.pop("bias"), rel=1e-9)
    assert set(places.tolist()) == {i for i, w in want.items() if w} and len(places)
    assert all(v == pytest.approx(want[i], rel=1e-9) for i, v in zip(places.tolist(), values.tolist()))


def test_packing_equals_a_plain_packer(spark, tokenizer, library):
    rng = random.Random(6)
    made = ["".join(rng.choices("abcd efg", k=rng.randint(1, 400))) for _ in range(150)] + ["twice", "twice", None, None, ""]
    rows = sharding.report(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(made)], DOCS), 5, tokenizer).collect()
    groups = {}
    for text in made:
        raw = (text or "").encode()
        own = groups.setdefault(hashlib.sha256(raw).hexdigest(), np.zeros(3))
        own += [len(raw) + 8, len(library.encode(text or "").ids), 1]
    capacity = np.maximum(1.0, sum(groups.values()) / 5)
    share = {d: g / capacity for d, g in groups.items()}
    left, shard = np.ones((5, 3)), {}

    def pack(digests, residual):
        for d in sorted(digests, key=lambda d: (-share[d].max(), d)):
            best = max(range(5), key=lambda s: (float(residual[s] @ (share[d] * np.array(sharding.WEIGHTS))), -s))
            shard[d] = best
            residual[best] -= share[d]

    heavy = [d for d in share if share[d].max() > sharding.HEAVY]
    pack(heavy, left)
    light = [d for d in share if share[d].max() <= sharding.HEAVY]
    if light:
        left = np.maximum(left, 0) + 1e-12
        pack(light, left * (sum(share[d] for d in light) / left.sum(0)))
    assert {r["doc_id"]: r["shard"] for r in rows} == {
        i: shard[hashlib.sha256((t or "").encode()).hexdigest()] for i, t in enumerate(made)}
