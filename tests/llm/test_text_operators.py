"""Tokenizing, language, toxicity, decontamination and fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factstore.llm import automaton, decontaminate, fingerprints, langid, token_counts, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    atoms = ["  ", " ", "\n", "\t", "a", "the", "'s", "'S", " ", "　", "\x1c", "\x85", "é", "é", "漢字", "١٢", "²",
             "<|endoftext|>", "<|endoftext", "!!", "a" * 17, "\U0001F600", "\x00", "ing", "-" * 10, "\r\n", "ZZZ"]
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choices("etaoin", k=n)) for n in (10, 199, 200, 201, 3000)]
    return texts + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF)])) for _ in range(40)) for _ in range(300)]


def test_automaton_equals_the_library(odd_texts, library):
    made = automaton.Automaton(automaton.read_vocabulary(PATH))
    coder = automaton.SegmentCoder(made.encode_all, made.lengths, made.specials, most=500)
    found = []
    for at in range(0, len(odd_texts), 97):  # the store is emptied on the way
        found += [np.frombuffer(x, "<u4").tolist() for x in coder.encode(odd_texts[at:at + 97])]
    want = [e.ids for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert found == want
    assert [made.decode(i) for i in want] == library.decode_batch(want, skip_special_tokens=False)
    rng = random.Random(6)
    loose = [[rng.randrange(50257) for _ in range(15)] for _ in range(300)]
    assert [made.decode(i) for i in loose] == library.decode_batch(loose, skip_special_tokens=False)


def test_followed_alone_or_side_by_side(library):
    made, rng = automaton.Automaton(automaton.read_vocabulary(PATH)), random.Random(7)
    words = ["".join(rng.choices("abcdefgh tion", k=rng.randint(1, 60))).replace(" ", "").encode() or b"x" for _ in range(500)]
    assert made.encode_words(words) == [made._search(w) for w in words]


def test_library_coder_equals_whole_texts(odd_texts, library):
    coder = token_counts.library_coder(open(PATH, "rb").read())
    want = [e.ids for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(odd_texts)] == want


def test_counts_come_from_the_cache(spark, tmp_path):
    tokenizer, cache = token_counts.read_tokenizer(PATH), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id bigint, text string")
    first = token_counts.count_tokens(docs, tokenizer, cache, 1).collect()
    assert spark.read.parquet(cache).count() == 2
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in first} == {
        1: (7, 2, True), 2: (7, 2, True), 3: (0, 0, False)}
    # A stored count is taken as it is, and only the new text is appended.
    spark.createDataFrame([(hashlib.sha256(b"new").hexdigest(), token_counts.tokenizer_digest(tokenizer), 77)],
                          token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    more = docs.unionByName(spark.createDataFrame([(4, "new"), (5, "newer")], docs.schema))
    second = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, tokenizer, cache, 1).collect()}
    assert second[4] == 77 and second[1] == 2 and spark.read.parquet(cache).count() == 4
    other = token_counts.read_tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["n_tokens"] for r in token_counts.count_tokens(docs, other, cache, 1).collect()} == {0, 2}
    assert spark.read.parquet(cache).count() == 6


def test_token_files_random_access(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "TOKENS_PER_FILE", 50)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc deé zq", k=rng.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame([(i * 7 % 61, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tokenizer = token_counts.read_tokenizer(PATH)
    manifest = token_files.write(docs, tokenizer, str(tmp_path), 70_000)
    assert manifest.count() > 10
    found = {r["doc_id"]: r for r in token_files.read(manifest).collect()}
    coder, start = token_counts.library_coder(tokenizer[1]), 0
    whole = {i * 7 % 61: np.frombuffer(x, "<u4").tolist() + [70_000] for i, x in enumerate(coder.encode(texts))}
    for doc_id in sorted(whole):
        row, ids = found[doc_id], np.array(whole[doc_id], "<u4").tobytes()
        assert (row["start"], row["n_tokens"], bytes(row["ids"]), row["ids_crc32"]) == (start, len(ids) // 4, ids, zlib.crc32(ids))
        start += len(ids) // 4


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1], 5000).astype(np.uint32)
    raw = token_files.pack(ids, [None, 5], np.array([0, 100, 5000]))
    read = []
    file = token_files.TokenFile(lambda at, size: read.append(size) or raw[at:at + size])
    assert file.documents()[0] == [None, 5] and file.documents()[1].tolist() == [0, 100, 5000]
    read.clear()
    assert [file.token(i) for i in range(0, 5000, 37)] == ids[::37].tolist()
    assert max(read) <= 64  # a block of bits at most
    for a, b in ((0, 5000), (511, 513), (17, 17), (4999, 5000)):
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file.token(5000)


def plain_hits(text, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = cut(text), set(), set()
    for name, item in items:
        own = cut(item)
        size = min(10, len(own))
        spans = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in spans:
                hit.update(range(i, i + size))
                names.add(name)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("block", [8_000_000, 400])
def test_decontamination_equals_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choices(["a", "b", "C", "d9", "é-x", "the"], k=n))
    items = [(str(i), some(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(25)] + [("x", None), ("y", "...")]
    texts = [
        f"{some(rng.randint(0, 60))}, {rng.choice(items[:25])[1]} {some(5)}" if rng.random() < 0.7 else some(80) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + [None, ""])), "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id string, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
             for r in decontaminate.contamination(docs, table).collect()}
    assert found == {i: plain_hits(t, items) for i, t in enumerate(texts + [None, ""])}
    clean = {r["doc_id"] for r in decontaminate.clean(docs, table).collect()}
    assert clean == {i for i, f in found.items() if f[1] == 0}


def test_language_has_no_last_language(spark):
    rng = random.Random(4)
    names = [f"l{i:03}" for i in range(405)]
    own = {g: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3)] for g in names}
    rows = [(i, " ".join(own[g]), g) for i, g in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert found == {i: g for i, _, g in rows}


def test_language_is_the_same_whatever_a_task_holds(spark, monkeypatch):
    rng = random.Random(3)
    letters = {"big": "abcdefgh", **{f"s{i}": "efghijkl"[i:] + "mn" for i in range(4)}}
    word = lambda g: "".join(rng.choices(letters[g], k=rng.randint(1, 9)))
    rows = [(i, " ".join(word(g) for _ in range(rng.randint(1, 20))), g) for i in range(600)
            for g in [rng.choice([*letters, *["big"] * 20])]] + [(900, "12 -", "big"), (901, None, "s1"), (902, "ωψ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")

    def predicted():
        return {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 5)) for r in langid.identify(docs).collect()}

    whole = predicted()
    assert len(whole) == len(rows) and whole[900][1] == "und"
    for cells in (20_000, 1_000, 5):
        monkeypatch.setattr(langid, "CELLS", cells)
        got = predicted()
        assert {i: g[:2] for i, g in got.items()} == {i: g[:2] for i, g in whole.items()}
        assert all(abs(g[2] - whole[i][2]) < 2e-5 for i, g in got.items())


def test_language_backs_off_to_grams(spark):
    rng = random.Random(2)
    parts = {"aa": ["ba", "bo", "bi", "be"], "kk": ["ka", "ko", "ki", "ke"]}
    word = lambda g: "".join(rng.choices(parts[g], k=rng.randint(1, 4)))
    rows = [(i, " ".join(word(g) for _ in range(rng.randint(3, 30))), g) for i in range(300) for g in [rng.choice(["aa", "kk"])]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs)
    scorer = langid.Scorer(model)
    assert scorer.predict("bobebibabobebaboba") == scorer.predict("BOBEBIBABOBEBABOBA") and scorer.predict("bobebibabobebaboba")[0] == "aa"
    assert scorer.predict("kokekikakokekakoko")[0] == "kk" and scorer.predict("12 --")[0] == "und"
    found = langid.identify(docs).collect()
    assert {r["doc_id"] for r in found if r["held_out"]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = {i: g for i, _, g in rows}
    assert all(r["lang_pred"] == right[r["doc_id"]] and 0 <= r["score"] <= 1 for r in found)
    counts = {}
    for _, text, g in rows:
        for w in text.split():
            counts[g, w] = counts.get((g, w), 0) + 1
    place, table = model["words"]
    total = {g: (sum(n for (h, _), n in counts.items() if h == g), len({w for h, w in counts if h == g})) for g in parts}
    for (g, w), n in counts.items():
        if w in place:
            n_words, n_distinct = total[g]
            assert abs(table[place[w], sorted(parts).index(g)] - np.log((n + 0.5) / (n_words + 0.5 * (n_distinct + 1)))) < 1e-9


def two_languages(rng):
    parts = {"aa": ["ba", "bo", "bi", "be"], "kk": ["ka", "ko", "ki", "ke"]}
    text = lambda g: " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 4))) for _ in range(rng.randint(50, 150)))
    return [(i, text(g), g) for i in range(300) for g in [rng.choice(["aa", "kk"])]]


def plain_gain(text, rows):
    """Likeness by dictionaries of n-grams."""
    size, mixers = langid.PLACES, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def counted(some):
        out = {}
        for word in re.findall(r"[^\W\d_]{1,64}", some.lower()):
            for i in range(len(word) - 1):
                place = (sum(ord(c) * k for c, k in zip(f"<{word}>"[i:i + 4], mixers)) % 2**64 >> 32) % size
                out[place] = out.get(place, 0) + 1
        return out

    own, gains, totals = counted(text), [], []
    for lang in {g for *_, g in rows}:
        whole = {}
        for _, some, g in rows:
            for place, n in counted(some if g == lang else "").items():
                whole[place] = whole.get(place, 0) + n
        totals.append(sum(whole.values()) + 1)
        rest = {p: max(0, n - own.get(p, 0)) for p, n in whole.items()}
        total = sum(rest.values()) + size / 2
        gain = sum(n * math.log((rest.get(p, 0) + 0.5) * size / total) for p, n in own.items())
        gains.append(gain * min(1, langid.ENOUGH / max(1, sum(own.values()))))
    return max(gain + math.log(n / sum(totals)) for gain, n in zip(gains, totals))


def test_likeness_is_that_of_the_counts(spark, monkeypatch):
    rows = two_languages(random.Random(6))
    likeness = langid.Likeness(langid.count(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    for text in (rows[0][1], "babo kaki", "boba x qqq zzzz ωψ", "a b", "ÄÖ " * 50 + "b" * 200, rows[1][1] * 9):
        want = plain_gain(text, rows)
        for held in (20_000, 2):
            monkeypatch.setattr(langid, "_WORDS", held)
            assert abs(likeness.gain(text) - want) < 1e-6 * max(1, abs(want))


def test_letters_in_no_language_go(spark):
    rng = random.Random(7)
    noise = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400))
    known = two_languages(rng) + [(400, "boba bibe", None), (401, "KOKI, kake!", None), (402, "zq", None)]
    # Labelled noise was learned from; a language of one row excludes little.
    strange = [(500, noise(), None), (501, noise(), "aa"), (502, noise(), "kk"), (503, "ωψαβ γδεζη " * 200, None), (504, "12 -", "aa"),
               (505, None, "aa")]
    rows = [(*r, "kept") for r in [*known, *strange, known[0], strange[0], (None, known[0][1], None), (600, "ba", "rare")]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, gain string").repartition(3)
    for counted in (langid.count(docs), langid.learn(docs)):
        kept = langid.known_language(docs, counted)
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in range(500, 506))
    assert langid.known_language(docs, langid.count(docs.where("lang = 'none'"))).collect() == []


def test_a_text_must_read_as_what_is_predicted(spark, monkeypatch):
    """A language of few n-grams excludes little, yet keeps no text that the prediction gives to another one."""
    rng = random.Random(8)
    known = [(i, text, "aa" if "b" in text else "kk") for i, text, _ in two_languages(rng)]
    known = [r for r in known if r[2] == "aa"] + [r for r in known if r[2] == "kk"][:2] + [(400, "boba bibe", None), (401, "KOKI, kake!", None)]
    words = ["".join(rng.choices("cdfghjlmnpqrstvwxyz", k=6)) for _ in range(300)]
    # The words of 500 are known from its label alone.
    junk = [(500, "zqxvwj dhtrln " * 200, "aa"), (501, " ".join(words), None), (502, "12 -", "aa"), (503, None, "kk"), (504, "", None)]
    rows = [(*r, "kept", i) for i, r in enumerate([*known, *junk, known[0], (None, known[0][1], None)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, gain string, row int").repartition(3)
    model = langid.learn(docs)
    scorer, likeness = langid.Scorer(model), langid.Likeness(model)
    assert scorer.predict(junk[0][1])[0] == "aa" and likeness.gain(junk[0][1]) > -np.log(langid.ODDS)

    def stays(text):
        lang, share = scorer.predict(text or "")
        if lang == "und":
            return False
        score, n = scorer.score(text)
        gains = likeness.gains(text) + (score - score.max()) * min(1, 30 / n)
        assert scorer.langs[int(score.argmax())] == lang and 0 <= share <= 1
        return gains.max() > -np.log(langid.ODDS)

    want = sorted(str(r) for r in docs.collect() if stays(r["text"]))
    assert not any(f"doc_id={i}," in r for r in want for i in (500, 502, 503, 504)) and len(want) >= len(known)
    for cells, few in ((langid.CELLS, langid.FEW), (1_000, langid.FEW), (5, 1), (5, 0)):
        monkeypatch.setattr(langid, "CELLS", cells)
        monkeypatch.setattr(langid, "FEW", few)
        for some in (langid.learn(docs), langid.count(docs)):
            kept = langid.known_language(docs, some)
            assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == want


def test_toxicity_learns_marked_words(spark):
    rng = random.Random(4)
    plain, bad = [f"w{i}" for i in range(60)], ["vile", "nasty", "foul"]
    rows = []
    for i in range(1200):
        toxic = int(rng.random() < 0.2)
        rows.append((i, " ".join(rng.choices(plain, k=30) + rng.choices(bad, k=2) * toxic), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic bigint")
    model = toxicity.learn(docs, labels)
    assert 0 < len(model[0]) < 2000
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(found[i]["predicted"], t) for i, _, t in rows if found[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert {i for i in found if found[i]["held_out"]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r["doc_id"] for r in toxicity.harmless(docs, model).collect()} == {i for i, r in found.items() if r["predicted"] == 0}


def plain_levels(data):
    out = []
    for i in range(len(data) - fingerprints.WINDOW + 1):
        counts = np.bincount(list(data[i:i + fingerprints.WINDOW]))
        share = counts[counts > 0] / fingerprints.WINDOW
        out.append(-(share * np.log2(share)).sum() / np.log2(fingerprints.WINDOW) * fingerprints.LEVELS)
    return out


def test_entropy_of_every_window():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(0, 4, 300), rng.integers(0, 256, 300), np.zeros(100)]).astype(np.uint8)
    found, want = fingerprints.entropy_levels(data), plain_levels(data)
    assert len(found) == len(want) and max(abs(a - min(b, 999)) for a, b in zip(found, want)) <= 1.01


def plain_features(data, ranks):
    levels = fingerprints.entropy_levels(np.frombuffer(data, np.uint8))
    if not len(levels):
        return []
    key = [(ranks[v], i) for i, v in enumerate(levels)]
    votes = [0] * len(key)
    for i in range(len(key) - fingerprints.NEIGHBOURS + 1):
        votes[min(key[i:i + fingerprints.NEIGHBOURS])[1]] += 1
    return sorted({i for i, v in enumerate(votes) if v >= fingerprints.VOTES} | {min(key)[1]})


@pytest.mark.parametrize("piece", [200_000, 100])
def test_features_do_not_depend_on_neighbours_or_pieces(monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "_PIECE", piece)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefg ", k=n)).encode() for n in (0, 5, 31, 32, 33, 63, 64, 200, 0, 1000, 10)]
    ranks = np.random.default_rng(4).permutation(fingerprints.LEVELS)
    x, bounds = fingerprints._join(texts)
    found = fingerprints.features(x, bounds, ranks)
    want = [b + i for t, b in zip(texts, bounds) for i in plain_features(t, ranks)]
    assert found.tolist() == want


def test_fingerprints_of_edited_and_next(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnop   ", k=rng.randint(300, 4000))) for _ in range(40)]
    texts[7] = texts[8] = texts[20]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"] // 3: r for r in fingerprints.compare(docs).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1]  # of the first row: the last one
        half = len(text) // 2
        changed = (text[:len(text) - half] + after[:half]).encode()
        assert found[i]["edited_sha256"] == hashlib.sha256(changed).hexdigest() and found[i]["n_chars"] == len(text)
        assert 0 <= found[i]["near_next"] <= 1 and (i == 8 or found[i]["near_edited"] > found[i]["near_next"])
    assert found[7]["fingerprint"] == found[8]["fingerprint"] == found[20]["fingerprint"]
    assert found[8]["near_next"] == 1.0
