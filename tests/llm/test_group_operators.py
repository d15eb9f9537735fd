"""Near duplicates, sharding, revisits and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from factstore.llm import automaton, decontaminate, langid, sharding, simhash, toxicity, warc


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """Smallest id reachable through fingerprints within four bits."""
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(prints))]
        if new == label:
            return label
        label = new


def test_fingerprint():
    for text in ("", " \n", "One", "a b c", "A b\tc d", "a b c d e  f " * 9, "é É x y z É"):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)
    whole = " ".join(map(str, range(500)))
    once = simhash.fingerprint(whole)
    before, simhash._SHINGLES_AT_ONCE = simhash._SHINGLES_AT_ONCE, 7
    try:
        assert simhash.fingerprint(whole) == once
    finally:
        simhash._SHINGLES_AT_ONCE = before


@pytest.mark.parametrize("cell", [4_000_000, 3000])
def test_links_connect_what_is_near(spark, cell):
    rng = random.Random(cell)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for base in list(prints)[:12]:
        at = base
        for _ in range(6):  # chains and clusters
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            prints.add(at)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), cell).collect()
    for e in edges:
        assert e["a"] != e["b"]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = plain_components(prints, signed)
    assert [found.get(p, p) for p in signed] == want
    assert len(set(want)) < len(want)


def test_components_of_a_long_path(spark):
    path = list(range(200))
    random.Random(1).shuffle(path)
    edges = spark.createDataFrame([*zip(path, path[1:]), (500, 501), (501, 502)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in path if i}, 501: 500, 502: 500}


def shares(rows, shards):
    return [(sum(r["size"] for r in rows if r["shard"] == s), sum(r["shard"] == s for r in rows)) for s in range(shards)]


@pytest.mark.parametrize("block", [50_000, 40])
def test_shards_are_balanced(spark, monkeypatch, block):
    import public_tokenizers

    from factstore.llm import token_counts

    monkeypatch.setattr(sharding, "BLOCK_GROUPS", block)
    monkeypatch.setattr(sharding, "PIECE_ROWS", 100)
    rng = random.Random(12)
    some = lambda: "".join(rng.choices("abcd efg", k=int(rng.lognormvariate(4, 1))))
    texts = [some() for _ in range(900)] + ["hot copy of a text"] * 400 + ["pair"] * 2
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    tokenizer = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sharding.report(docs, 6, tokenizer).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    sizes = [s for s, _ in shares(rows, 6)]
    assert max(sizes) / min(sizes) < 1.05
    counts = [n for _, n in shares(rows, 6)]
    assert max(counts) / min(counts) < 1.3
    for shard in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "pair"}) == 1


def test_place_takes_the_highest_dot_product():
    left = np.array([[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]])
    found = sharding.place(np.array([[0.1, 0.1, 0.1], [0.9, 0.9, 0.9], [0.5, 0.5, 0.5]]), left)
    assert found.tolist() == [1, 0, 1]
    assert np.allclose(left, [[0.1] * 3, [0.4] * 3])


def record(record_id, url, ts, kind="response", status=200, etag=None, last=None, headers=None, digest=None):
    return (record_id, url, ts, kind, status, etag, last, headers, digest, f"body {record_id}", "extra")


FIELDS = ("record_id string, url string, ts bigint, kind string, status int, etag string, last_modified string, "
          "headers map<string,string>, digest string, payload string, latest string")


def revisit(record_id, url, ts, **more):
    return record(record_id, url, ts, "revisit", 304, **more)


@pytest.mark.parametrize("points", [100_000, 2])
def test_revisits(spark, monkeypatch, points):
    monkeypatch.setattr(warc, "RANGE_POINTS", points)
    rows = [
        record("a1", "http://www.X.com:80/p/?b=2&a=1#f", 10, etag='"1"', last="m1", headers={"etag": '"1"', "server": "s", "date": "10"}, digest="d1"),
        record("a2", "https://x.com/p?a=1&b=2", 20, etag='"2"', last="m2", headers=None, digest="d2"),
        record("a3", "https://x.com/p?a=1&b=2", 20, etag='"3"', last="m3", headers={"server": "t"}, digest="d3"),
        record("e", "https://x.com/p?a=1&b=2", 25, status=404, etag='"9"'),
        record("n", None, 1), record("t", "x.com/t", None),
        revisit("r1", "x.com/p?b=2&a=1", 15, etag='W/"1"', headers={"date": "15", "server": "no"}),
        revisit("r2", "x.com/p?b=2&a=1", 20, etag='"1"'),
        revisit("r3", "x.com/p?b=2&a=1", 30, etag='"3"', last="other"),
        revisit("r4", "x.com/p?b=2&a=1", 31, etag='"1"'),
        revisit("r5", "x.com/p?b=2&a=1", 32, last="m3"), revisit("r5", "x.com/p?b=2&a=1", 32, last="m3"),
        revisit("r6", "x.com/p?b=2&a=1", 33, last="m2"), revisit("r7", "x.com/p?b=2&a=1", 34),
        revisit("r8", "x.com/p?b=2&a=1", 10), revisit("r9", "y.org", 99), revisit("r10", None, 99), revisit("r11", "x.com/t", None)]
    records = spark.createDataFrame(rows, FIELDS).repartition(3)
    resolved = warc.resolve(records)
    found = [(r["record_id"], r["outcome"], r["response_id"], r["digest"]) for r in resolved.collect()]
    assert sorted(found) == sorted([
        ("r1", "resolved", "a1", "d1"), ("r2", "resolved", "a1", "d1"), ("r3", "resolved", "a3", "d3"),
        ("r4", "validator_mismatch", "a3", None), *[("r5", "resolved", "a3", "d3")] * 2, ("r6", "validator_mismatch", "a3", None),
        ("r7", "resolved", "a3", "d3"), ("r8", "no_response", None, None), ("r9", "no_response", None, None),
        ("r10", "no_response", None, None), ("r11", "no_response", None, None)])
    merged = {r["record_id"]: r["headers"] for r in resolved.collect()}
    assert merged["r1"] == {"etag": '"1"', "server": "s", "date": "15"} and merged["r7"] == {"server": "t"}
    bodies = {r["record_id"]: r["payload"] for r in warc.with_payload(resolved, records).collect()}
    assert bodies["r1"] == "body a1" and bodies["r3"] == "body a3" and "r4" not in bodies
    assert warc.resolve(records.limit(0)).collect() == []


def test_many_revisits_of_one_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_POINTS", 20)
    rng = random.Random(3)
    rows = [record(f"a{i:03}", rng.choice(["h.com", "h.com", "i.com"]), rng.randrange(200)) for i in range(60)]
    rows += [revisit(f"r{i:03}", rng.choice(["h.com", "i.com"]), rng.randrange(200)) for i in range(200)]
    found = {r["record_id"]: r["response_id"] for r in warc.resolve(spark.createDataFrame(rows, FIELDS)).collect()}
    for r in rows[60:]:
        earlier = [(a[2], a[0]) for a in rows[:60] if a[1] == r[1] and a[2] < r[2]]
        assert found[r[0]] == (max(earlier)[1] if earlier else None)


def test_pipeline_stages(spark):
    """Each stage keeps what its operator's report says, and the whole is the stages in order."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df, test: {r["doc_id"] for r in df.collect() if test(r)}
    expected = {
        "toxicity": lambda d: ids(toxicity.score(d, toxicity.learn(d, labels)), lambda r: not r["predicted"]),
        "language": lambda d: ids(langid.identify(d), lambda r: r["lang_pred"] != "und"),
        "near_duplicates": lambda d: ids(simhash.near_duplicates(d), lambda r: r["doc_id"] == r["component_id"]),
        "decontamination": lambda d: ids(decontaminate.contamination(d, items), lambda r: not r["contaminated"])}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        want = expected[name](docs)
        docs = docs.sparkSession.createDataFrame(kept.collect(), docs.schema)
        assert [r["doc_id"] for r in docs.orderBy("doc_id").collect()] == sorted(want)
    import public_tokenizers
    vocabulary = automaton.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    last = sorted(map(tuple, automaton.digests(docs, vocabulary).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == last


def test_the_language_stage_decides_by_what_was_learned(spark):
    """Random letters and a script that no labelled row has do not reach the next stage; all else does."""
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200)) for _ in range(8)]
    noise.append("Γειά σου κόσμε, τι κάνεις σήμερα και αύριο; " * 5)
    added = [(10**6 + i, text, [None, "en", "de"][i % 3], "src0", len(text)) for i, text in enumerate(noise)]
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(added, docs.schema)), "")
    want = [r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_groups_of_few_bytes_stay_whole(spark):
    """Null and short hot texts are many rows and few bytes, so nothing asks to split them."""
    import public_tokenizers

    from factstore.llm import token_counts

    rng = random.Random(4)
    texts = [None] * 300 + ["ab"] * 300 + ["".join(rng.choices("abcd efg", k=300)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = sharding.report(docs, 4, token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    for text in (None, "ab"):
        assert len({r["shard"] for r in rows if texts[r["doc_id"]] == text}) == 1
    sizes = [s for s, _ in shares(rows, 4)]
    assert len(rows) == 800 and max(sizes) / min(sizes) < 1.05
    none = sharding.report(spark.createDataFrame([(i, None) for i in range(40)], "doc_id bigint, text string"), 4,
                           token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert {n for _, n in shares(none, 4)} <= set(range(5, 16)) and sum(n for _, n in shares(none, 4)) == 40
