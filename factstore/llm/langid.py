"""Language identification by words first, character n-grams where a word is unknown.

Learning counts, in every labelled row it is given, the words of each language and their
n-grams, and keeps all of them as tables. A known word scores by its log frequency in each
language. An unseen word is cut into n-grams of the longest length; the places that no known
n-gram covers go to the next shorter length, down to single letters.

Each task holds the most frequent words and n-grams, up to ``CELLS`` log frequencies a table.
Words that are not among them are joined with the whole counts, so what a task holds decides
the time and not the prediction. Their scores are summed as whole numbers, in any order.

A text without a letter, or a null text, is ``und`` with score 0. Rows without a label or
text are not learned from. Without any label every text is ``und``. The score is the share
of the best language among all, from the mean log likelihood of a word. Ties go to the
language that sorts first. Repeated rows, null ids and extra columns change nothing.

``known_language`` predicts as above and asks more: whether a text reads as the predicted language,
or as another one by more than the prediction speaks against that. It holds the
text's longest n-grams against letters at random, by hashed places that all n-grams of the
whole counts share, so none is left out. What the text itself may have taught is taken off;
copies of a text do teach each other. A language weighs by its share of the learned n-grams, so
that one with few, which excludes little, does not let everything pass. A text of few unknown
words stays where little was learned, as it tells too little; so do texts of one-letter words.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factstore.llm.common import filter_rows, fold, fresh_name, saved, slices

#: Log frequencies of words, and of n-grams of a length, that a task holds; letters of a word.
CELLS, LETTERS = 500_000, 64
#: A log frequency of one in the sums of joined words.
ONE = 1 << 30
LONGEST = 4
#: Different words, or n-grams, that a task counts before it hands them on.
_KEPT = 400_000
#: Places of the longest n-grams for up to 8 languages (fewer for more), and the words of a text that are hashed at a time.
PLACES, _WORDS = 1 << 19, 20_000
#: A text is in no known language where letters at random are so many times likelier than each one.
ODDS = 10_000
#: N-grams that a longer text counts for.
ENOUGH = 1000
#: Digests of texts that a task holds; more are joined.
FEW = 50_000
UNKNOWN = "und"
_WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")


def words(text: str) -> list[str]:
    """Runs of letters; a longer run than ``LETTERS`` is several words."""
    return _WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def grams(word: str, size: int) -> list[str]:
    framed = f"<{word}>" if size > 1 else word
    return [framed[i:i + size] for i in range(len(framed) - size + 1)]


def count(docs: DataFrame) -> dict:
    """The whole counts: languages with their numbers of words, and tables of words and n-grams."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))],
                                   ["lang", "word", "n"])

        for batch, texts in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) > _KEPT:
                yield flush()
        if any(held.values()):
            yield flush()

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = saved(labelled.mapInArrow(gather, "lang string, word string, n bigint").groupBy("lang", "word")
                   .agg(F.sum("n").alias("n")), "word-counts")
    totals = {r["lang"]: (r["n"], r["v"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
              .collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[str, int]] = {}

        def flush():
            rows = [(lang, size, g, n) for (lang, size), counted in held.items() for g, n in counted.items()]
            held.clear()
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["lang", "size", "gram", "n"])

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for size in range(1, LONGEST + 1):
                    counted = held.setdefault((lang, size), {})
                    for g in grams(word, size):
                        counted[g] = counted.get(g, 0) + n
            if sum(map(len, held.values())) > _KEPT:
                yield flush()
        if any(held.values()):
            yield flush()

    cuts = saved(counts.mapInArrow(cut, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram")
                 .agg(F.sum("n").alias("n")), "gram-counts")
    return {"langs": sorted(totals), "totals": totals, "counts": counts, "cuts": cuts}


def learn(docs: DataFrame) -> dict:
    """The model: the counts, and word rows and n-gram rows of log frequencies."""
    return fitted(count(docs))


def fitted(counted: dict) -> dict:
    """The model of the counts."""
    langs, totals, counts, cuts = (counted[k] for k in ("langs", "totals", "counts", "cuts"))
    held = max(1, CELLS // max(1, len(langs)))
    sized = counts.withColumn("size", F.lit(0)).withColumnRenamed("word", "key")
    whole, tables = _frequent(sized, held)
    whole_grams, gram_tables = _frequent(cuts.withColumnRenamed("gram", "key"), held)
    whole, tables = whole | whole_grams, tables | gram_tables
    gram_totals = {(r["lang"], r["size"]): (r["n"], r["v"]) for r in
                   cuts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    of_size = {0: totals} | {s: {g: gram_totals.get((g, s), (0, 1)) for g in langs} for s in range(1, LONGEST + 1)}
    return counted | {"words": _logs(tables.get(0, []), langs, totals),
            "grams": {s: _logs(tables.get(s, []), langs, of_size[s]) for s in range(1, LONGEST + 1)},
            "base": {s: np.log(0.5 / _sizes(langs, t)) for s, t in of_size.items()},
            "whole": {s: whole.get(s, True) for s in of_size}}


def _frequent(rows: DataFrame, held: int) -> tuple[dict, dict]:
    """By ``size``: whether all keys are held, and the rows of the most frequent, at most ``held`` keys."""
    totals = rows.groupBy("size", "key").agg(F.sum("n").alias("total"))
    # How many keys occur how often is a short list, from which the cut follows without a sort of the keys.
    often: dict[int, list] = {}
    for r in totals.groupBy("size", "total").agg(F.count("*").alias("keys")).orderBy("size", F.desc("total")).toLocalIterator():
        often.setdefault(r["size"], []).append((r["total"], r["keys"]))
    whole, wanted = {}, F.lit(False)
    for size, counted in often.items():
        sums = np.cumsum([k for _, k in counted])
        fits = int(np.searchsorted(sums, held, side="right"))
        whole[size] = fits == len(counted)
        if fits:
            wanted = wanted | ((F.col("size") == size) & (F.col("total") >= counted[fits - 1][0]))
    kept = rows.join(totals.where(wanted).select("size", "key"), ["size", "key"], "left_semi").select("size", "lang", "key", "n").toArrow()
    tables: dict[int, list] = {}
    for size, *row in zip(*(kept.column(c).to_pylist() for c in ("size", "lang", "key", "n"))):
        tables.setdefault(size, []).append(row)
    return whole, tables


def _sizes(langs: list[str], totals: dict) -> np.ndarray:
    return np.array([totals[g][0] + 0.5 * (totals[g][1] + 1) for g in langs])


def _logs(rows: list[tuple], langs: list[str], totals: dict) -> tuple[dict[str, int], np.ndarray]:
    """Rows of smoothed log frequencies, and the row of each key."""
    place = {k: i for i, k in enumerate(sorted({r[1] for r in rows}))}
    column = {g: i for i, g in enumerate(langs)}
    found = np.zeros((len(place), len(langs)))
    for lang, key, n in rows:
        if lang in column:
            found[place[key], column[lang]] = n
    return place, np.log((found + 0.5) / _sizes(langs, totals))


class Scorer:
    def __init__(self, model: dict):
        self.langs, (self.place, table), self.grams = model["langs"], model["words"], model["grams"]
        self.table = np.concatenate([table, np.zeros((1, len(self.langs)))])
        self.base, self.whole = model["base"], model["whole"]

    def back_off(self, word: str, joined: dict | None = None) -> np.ndarray:
        """Mean score of the n-grams that cover the word, the longest known ones first.

        Where all of the longest are known, they decide alone.
        ``joined`` holds scores of n-grams, by length and n-gram, that are not among the held ones.
        """
        def scores(size, gram):
            place, table = self.grams[size]
            row = place.get(gram)
            return table[row] if row is not None else (joined or {}).get((size, gram))

        own = [scores(LONGEST, gram) for gram in grams(word, LONGEST)]
        if own and all(s is not None for s in own):
            return np.mean(own, axis=0)
        total, used, free = np.zeros(len(self.langs)), 0, [True] * len(word)
        for size in range(LONGEST, 0, -1):
            shift = 1 if size > 1 else 0
            for i, gram in enumerate(grams(word, size)):
                over = range(max(0, i - shift), min(len(word), i - shift + size))
                found = scores(size, gram) if any(free[k] for k in over) else None
                if found is not None:
                    total += found
                    used += 1
                    for k in over:
                        free[k] = False
        return total / max(1, used)

    def open_grams(self, word: str) -> set[tuple[int, str]]:
        """N-grams of the word that only the whole counts can tell known or not."""
        return {(size, g) for size in range(1, LONGEST + 1) if not self.whole[size]
                for g in grams(word, size) if g not in self.grams[size][0]}

    def held(self, text: str) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, the sum of the scores of the held ones, and the others."""
        found = words(text) if self.langs and has_letter(text) else []
        rows = np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))
        return len(found), self.table[rows].sum(0), [found[i] for i in np.flatnonzero(rows < 0).tolist()]

    def odds(self, score: np.ndarray, found: int) -> np.ndarray:
        """Logarithms of each language's odds against the best one."""
        # A few words decide on their own; a long text counts as a few dozen.
        share = score / found * min(found, 30)
        return share - share.max()

    def best(self, score: np.ndarray, found: int) -> tuple[str, float]:
        if not found:
            return UNKNOWN, 0.0
        share = np.exp(self.odds(score, found))
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())

    def predict(self, text: str) -> tuple[str, float]:
        return self.best(*self.score(text))

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """The sum of the words' scores in each language, and the number of words."""
        found, score, unseen = self.held(text)
        # Longest n-grams that cover a word without a gap decide alone; their means are taken together.
        longest, table = self.grams[LONGEST]
        gram, covered, sizes = longest.get, [], []
        for word in unseen:
            framed = f"<{word}>"
            own = [gram(framed[i:i + LONGEST]) for i in range(len(framed) - LONGEST + 1)]
            if own and None not in own:
                covered += own
                sizes.append(len(own))
            else:
                score += self.back_off(word)
        if sizes:
            sizes = np.array(sizes)
            score += np.repeat(1 / sizes, sizes) @ table[covered]
        return score, found


def _held(model: dict) -> dict:
    """What tasks get of the model."""
    return {k: model[k] for k in ("langs", "words", "grams", "base", "whole")}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; only the text decides."""
    held = _held(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held)
        for batch, texts in slices(batches):
            found = [scorer.predict(t) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    rows = docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text")
    if all(model["whole"].values()):
        return rows.mapInArrow(run, shape)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held)
        for batch, texts in slices(batches):
            found, sums, rest = zip(*map(scorer.held, texts))
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.int64()),
                 pa.array(sums, pa.list_(pa.float64())), pa.array([list(Counter(r).items()) for r in rest], pa.map_(pa.string(), pa.int64()))],
                ["row", "doc_id", "held_out", "found", "sums", "rest"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held)
        for batch in batches:
            got = [scorer.best(score, found) for score, found in _whole_scores(scorer, batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                                   pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    # The numbers of the rows hold from here on, as they are written.
    scanned = saved(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        scan, f"row bigint, doc_id {kind}, held_out boolean, found bigint, sums array<double>, rest map<string,bigint>"), "language-scan")
    return _joined(scanned, model).mapInArrow(finish, shape)


def _joined(scanned: DataFrame, model: dict) -> DataFrame:
    """The rows without ``rest``, and the ``parts`` that its words add to the scores."""
    rest = scanned.select("row", F.explode("rest").alias("word", "times"))
    parts = (rest.join(_parts(rest.select("word").distinct(), model), "word").repartition("row")
             .select("row", "times", F.inline("parts")).groupBy("row", "k").agg(F.sum(F.col("v") * F.col("times")).alias("v"))
             .groupBy("row").agg(F.collect_list(F.struct("k", "v")).alias("parts")))
    return scanned.drop("rest").join(parts, "row", "left")


def _whole_scores(scorer: Scorer, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
    """The scores with all parts, and the numbers of words."""
    for found, sums, parts in zip(*(batch.column(c).to_pylist() for c in ("found", "sums", "parts"))):
        score = np.array(sums)
        for part in sorted(parts or [], key=lambda p: p["k"]):
            if part["k"] < 0:
                score += part["v"] / ONE * scorer.base[-1 - part["k"]]
            else:
                score[part["k"]] += part["v"] / ONE
        yield score, found


def _parts(asked: DataFrame, model: dict) -> DataFrame:
    """``word, parts`` of the words: what each adds to language ``k``, in units of 1 / ``ONE``.

    The part -1 counts known words: every language gets what it gives a word that it does not hold.
    """
    held, spark = _held(model), asked.sparkSession
    shape = "word string, parts array<struct<k:int,v:bigint>>"
    places = F.broadcast(spark.range(1).select(F.posexplode(F.lit(model["langs"])).alias("k", "lang")))
    gain = F.round(F.log(2 * F.col("n") + 1) * ONE).cast("bigint")
    known = (model["counts"].join(places, "lang").groupBy("word").agg(F.collect_list(F.struct("k", gain.alias("v"))).alias("parts"))
             .select("word", F.concat("parts", F.array(F.struct(F.lit(-1).alias("k"), F.lit(ONE).cast("bigint").alias("v")))).alias("parts")))
    met = asked.join(known, "word", "left")
    if not all(model["whole"].values()):
        met = saved(met, "language-words")
    unseen = met.where(F.col("parts").isNull()).select("word")

    def split(scorer: Scorer, word: str, joined: dict) -> list[tuple[int, int]]:
        """The score of an unseen word; every language gets its own number."""
        return [(k, round(float(x) * ONE)) for k, x in enumerate(scorer.back_off(word, joined)) if x]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held)
        for batch in batches:
            yield _packed([(w, split(scorer, w, {})) for w in batch.column("word").to_pylist()])

    if all(model["whole"][s] for s in range(1, LONGEST + 1)):
        backed = unseen.mapInArrow(alone, shape)
    else:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(held)
            for batch in batches:
                rows = [(w, s, g) for w in batch.column("word").to_pylist() for s, g in [(0, ""), *sorted(scorer.open_grams(w))]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))],
                                      ["word", "size", "gram"]) if rows else pa.record_batch(
                    [pa.array([], t) for t in (pa.string(), pa.int32(), pa.string())], ["word", "size", "gram"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, word, joined = Scorer(held), None, {}
            for batch in batches:
                done = []
                for w, s, g, counted in zip(*(batch.column(c).to_pylist() for c in ("word", "size", "gram", "counted"))):
                    if w != word:
                        if word is not None:
                            done.append((word, split(scorer, word, joined)))
                        word, joined = w, {}
                    if counted:
                        joined[s, g] = scorer.base[s].copy()
                        for c in counted:
                            joined[s, g][c["k"]] += np.log(2 * c["n"] + 1)
                yield _packed(done)
            if word is not None:
                yield _packed([(word, split(scorer, word, joined))])

        counted = (model["cuts"].join(places, "lang").groupBy("size", "gram")
                   .agg(F.collect_list(F.struct("k", "n")).alias("counted")))
        asks = unseen.mapInArrow(ask, "word string, size int, gram string")
        backed = (asks.join(counted, ["size", "gram"], "left").select("word", "size", "gram", "counted")
                  .repartition("word").sortWithinPartitions("word").mapInArrow(gather, shape))
    return met.where(F.col("parts").isNotNull()).unionByName(backed)


def _packed(rows: list[tuple[str, list[tuple[int, int]]]]) -> pa.RecordBatch:
    """Words with their parts."""
    kind = pa.list_(pa.struct([("k", pa.int32()), ("v", pa.int64())]))
    return pa.record_batch([pa.array([w for w, _ in rows], pa.string()),
                            pa.array([[{"k": k, "v": v} for k, v in p] for _, p in rows], kind)], ["word", "parts"])


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the fold 0 of 5 and predict all."""
    return predict(docs, learn(docs.where(fold(5) != 0)))


def _hashed(grams: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Places of n-grams, given by their first, second, third and fourth letters."""
    mixed = (x.astype(np.uint64) * np.uint64(k) for x, k in
             zip(grams, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)))
    return ((sum(mixed) >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def places(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places, of ``size``, of the text's longest n-grams, and how often each occurs."""
    parts, found = [], words(text)
    for at in range(0, len(found), _WORDS):
        codes = _codes(f"<{'><'.join(found[at:at + _WORDS])}>")
        a, b, c, d = (codes[i:len(codes) - LONGEST + 1 + i] for i in range(LONGEST))
        # A mark inside belongs to two words.
        inside = (b != ord("<")) & (b != ord(">")) & (c != ord(">"))
        parts.append(np.unique(_hashed((x[inside] for x in (a, b, c, d)), size), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    every = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)])
    keys, back = np.unique(every, return_inverse=True)
    return keys, np.bincount(back, np.concatenate([np.zeros(0), *(n for _, n in parts)]), len(keys))


class Likeness:
    """How much likelier a text is in its best language than as letters at random."""

    def __init__(self, counted: dict):
        self.langs = counted["langs"]
        self.size = size = PLACES >> max(0, (len(self.langs) - 1).bit_length() - 3)
        column = {g: i for i, g in enumerate(self.langs)}

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = _codes("".join(batch.column("gram").to_pylist())).reshape(-1, LONGEST)
                yield pa.record_batch([batch.column("lang"), pa.array(_hashed(codes.T, size), pa.int64()), batch.column("n")],
                                      ["lang", "place", "n"])

        summed = (counted["cuts"].where(F.col("size") == LONGEST).select("lang", "gram", "n")
                  .mapInArrow(place, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow())
        known, at = np.unique(summed.column("place").to_numpy(), return_inverse=True)
        # The last key and row stand for places that no language has.
        self.keys, self.table = np.append(known, size), np.zeros((len(known) + 1, len(self.langs)))
        self.table[at, [column[g] for g in summed.column("lang").to_pylist()]] = summed.column("n").to_numpy()
        self.totals = self.table.sum(0)
        self.weights = np.log((self.totals + 1) / (self.totals.sum() + len(self.langs)))

    def gain(self, text: str) -> float:
        """The logarithm."""
        return float(self.gains(text).max())

    def gains(self, text: str) -> np.ndarray:
        """The logarithm for each language; what the text itself may have taught is taken off the counts."""
        found, times = places(text, self.size)
        row = np.searchsorted(self.keys, found)
        row = np.where(self.keys[row] == found, row, len(self.keys) - 1)
        whole = self.table[row]
        rest = np.maximum(whole - times[:, None], 0)
        totals = self.totals - (whole - rest).sum(0)
        n = times.sum()
        gains = times @ np.log(rest + 0.5) + n * np.log(self.size / (totals + 0.5 * self.size))
        return gains * min(1, ENOUGH / max(1, n)) + self.weights


def known_language(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose text reads as a learnt language, with all their columns.

    The language of every text is predicted as ``predict`` does; ``und`` goes. So does a text of which
    letters at random are ``ODDS`` times likelier than the predicted language, and than each other one, which
    counts less by the odds that the prediction gives against it. ``model`` comes from ``learn``, or from
    ``count`` and is completed here.
    """
    model = model if "words" in model else fitted(model)
    scorer, likeness, least = Scorer(model), Likeness(model), -np.log(ODDS)

    def reads(score: np.ndarray, found: int, gains: np.ndarray) -> bool:
        return bool((scorer.odds(score, found) + gains).max() > least)

    def passes(text: str) -> bool:
        score, found = scorer.score(text)
        return found > 0 and reads(score, found, likeness.gains(text))

    if all(model["whole"].values()):
        return filter_rows(docs, lambda texts: [passes(t) for t in texts])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found, sums, rest = zip(*map(scorer.held, texts))
            gains = [likeness.gains(t) if n else [] for n, t in zip(found, texts)]
            yield pa.record_batch(
                [batch.column("row"), pa.array(map(_digest, texts), pa.string()), pa.array(found, pa.int64()), pa.array(sums, pa.list_(pa.float64())),
                 pa.array(gains, pa.list_(pa.float64())), pa.array([list(Counter(r).items()) for r in rest], pa.map_(pa.string(), pa.int64()))],
                ["row", "digest", "found", "sums", "gains", "rest"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [not found or not reads(score, found, np.array(gains)) for (score, found), gains in
                    zip(_whole_scores(scorer, batch), batch.column("gains").to_pylist())]
            yield batch.select(["digest"]).filter(pa.array(gone, pa.bool_()))

    # Only the text decides, so the digests of the texts that go tell the rows; texts do not move with their scores.
    scanned = saved(docs.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        scan, "row bigint, digest string, found bigint, sums array<double>, gains array<double>, rest map<string,bigint>"), "language-scan")
    gone = saved(_joined(scanned, model).mapInArrow(finish, "digest string").distinct(), "language-gone")
    few = {r["digest"] for r in gone.limit(FEW + 1).collect()}
    if len(few) <= FEW:
        return filter_rows(docs, lambda texts: [_digest(t) not in few for t in texts])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.record_batch([*batch.columns, pa.array(map(_digest, texts), pa.string())], [*batch.schema.names, name])

    name = fresh_name(docs.columns, "digest")
    return (docs.mapInArrow(digested, StructType([*docs.schema, StructField(name, StringType())]))
            .join(gone.withColumnRenamed("digest", name), name, "left_anti").drop(name))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
