"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``WINDOW`` consecutive words, an item of fewer words is one
window. A window is the set of its shingles at their places. For exact containment the
necessary prefix of a set is its rarest element alone, so each window is posted under the
one shingle that occurs in the fewest places of the corpus. A shingle of a document that
meets a posting proposes a window start, by the shingle's place within the window; the
start must leave room for the whole window (positional and length bounds), and then all
words are compared.

Shingles are counted over all documents. Windows are joined in blocks of bounded size,
each sent to the tasks in one pass over the documents, so a large benchmark costs passes
and never memory.

Null texts and texts without words have no words and match nothing. Repeated items count
once by their id, a null item id counts as the empty text, repeated documents each get
their row, and a null document id is kept. Without items every document is clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factstore.llm.common import saved, slices

WINDOW = 10
SHINGLE = 3
#: Bytes of window text in a block.
BLOCK_BYTES = 8_000_000

#: ASCII letters become small, all that is not an ASCII letter or digit a blank; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(items: DataFrame) -> DataFrame:
    """``window`` (words joined by a blank) and ``item_id`` as text, each pair once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = words(text)
                spans = {b" ".join(found[i:i + WINDOW]) for i in range(max(1, len(found) - WINDOW + 1))} if found else ()
                spans = [s.decode() for s in spans]
                yield pa.record_batch([pa.array([item] * len(spans), pa.string()), pa.array(spans, pa.string())],
                                      ["item_id", "window"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, window string").distinct()


def _shingles(span: tuple[int, ...]) -> list[tuple[int, ...]]:
    size = min(SHINGLE, len(span))
    return [span[i:i + size] for i in range(len(span) - size + 1)]


class Block:
    """The windows of one block with the vocabulary of their words."""

    def __init__(self, rows: list[tuple[str, str]]):
        spans = sorted({w for _, w in rows})
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in spans for w in s.encode().split()}))}
        self.spans = [tuple(self.vocabulary[w] for w in s.encode().split()) for s in spans]
        numbered = {s: i for i, s in enumerate(spans)}
        self.items: list[list[str]] = [[] for _ in spans]
        for item, span in rows:
            self.items[numbered[span]].append(item)
        every = sorted({s for span in self.spans for s in _shingles(span)})
        self.number = {s: i for i, s in enumerate(every)}
        # Shingles of a size, by place: a table of codes for each size in use.
        self.codes = {}
        for size in {len(s) for s in every}:
            own = [s for s in every if len(s) == size]
            codes = self.code(np.array(own, np.int64).T)
            order = np.argsort(codes)
            self.codes[size] = codes[order], np.array([self.number[s] for s in own])[order]

    def code(self, columns) -> np.ndarray:
        """One number for a shingle of word numbers; exact, as vocabularies stay below 2^21 words."""
        out = np.zeros(len(columns[0]), np.int64)
        for column in columns:
            out = out << 21 | column
        return out

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in found], np.int64)

    def meets(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the text where a shingle of the block stands, and the shingle's number."""
        for size, (codes, number) in self.codes.items():
            if len(ids) < size:
                continue
            columns = [ids[i:len(ids) - size + 1 + i] for i in range(size)]
            at = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in columns]))
            code = self.code([c[at] for c in columns])
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[place] == code
            yield at[hit], number[place[hit]]


def rarity(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of the block occurs, over all documents."""
    size = len(block.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for _, texts in slices(batches):
            met = [n for t in texts for _, n in block.meets(block.numbers(words(t)))]
            if met:
                counts += np.bincount(np.concatenate(met), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], ["shingle", "n"])

    found = docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in found.toLocalIterator():  # at most one row for each shingle of the block
        counts[row["shingle"]] = row["n"]
    return counts


def postings(block: Block, counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Each window under its rarest shingle: shingle to (window, place of the shingle in it)."""
    found = defaultdict(list)
    for window, span in enumerate(block.spans):
        numbers = [block.number[s] for s in _shingles(span)]
        place = min(range(len(numbers)), key=lambda i: (counts[numbers[i]], numbers[i]))
        found[numbers[place]].append((window, place))
    return dict(found)


class Matcher:
    def __init__(self, block: Block, posted: dict[int, list[tuple[int, int]]]):
        self.block, self.posted = block, posted
        self.wanted = np.zeros(len(block.number) + 1, bool)
        self.wanted[list(posted)] = True

    def find(self, found: list[bytes]) -> list[tuple[int, int]]:
        """(start, window) of every window that the words contain."""
        ids, out = self.block.numbers(found), []
        for at, numbers in self.block.meets(ids):
            use = self.wanted[numbers]
            for place, number in zip(at[use].tolist(), numbers[use].tolist()):
                for window, offset in self.posted[number]:
                    span, start = self.block.spans[window], place - offset
                    if start >= 0 and start + len(span) <= len(ids) and tuple(ids[start:start + len(span)].tolist()) == span:
                        out.append((start, window))
        return out


def matchers(docs: DataFrame, items: DataFrame) -> tuple[int, Iterator[Matcher]]:
    """How many blocks the benchmark's windows fill, and a matcher for each, one held at a time."""
    rows = windows(items)
    size = rows.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 16)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("window"), F.lit(max(1, count)))

    def each():
        for k in range(count):
            block = Block([tuple(r) for r in rows.where(part == k).collect()])
            yield Matcher(block, postings(block, rarity(docs, block)))

    return count, each()


def _covered(starts: list[tuple[int, int]]) -> int:
    """Words inside the union of (start, end)."""
    total, reached = 0, 0
    for start, end in sorted(starts):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, and ``items``, of every row."""
    count, each = matchers(docs, items)
    if count > 1:
        return _by_blocks(docs, each)
    found = list(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            n_words, n_hit, names = [], [], []
            for text in texts:
                own = words(text)
                hits = [(m, s, w) for m in found for s, w in m.find(own)]
                n_words.append(len(own))
                n_hit.append(_covered([(s, s + len(m.block.spans[w])) for m, s, w in hits]))
                names.append(sorted({i for m, _, w in hits for i in m.block.items[w]}))
            yield _result(batch.column("doc_id"), n_words, n_hit, names)

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs))


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
            "contaminated boolean, items array<string>")


def _result(doc_ids: pa.Array, n_words: list[int], n_hit: list[int], names: list[list[str]]) -> pa.RecordBatch:
    digests = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]
    return pa.record_batch(
        [doc_ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()),
         pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(names, pa.list_(pa.string()))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def _by_blocks(docs: DataFrame, each: Iterator[Matcher]) -> DataFrame:
    """As the plain pass, with one pass for each block: every pass adds its hits to the row it found them in."""
    hits = "hits"
    rows = docs.select("doc_id", "text", F.array().cast("array<struct<s:bigint,e:bigint,i:array<string>>>").alias(hits))
    for matcher in each:
        def add(batches, matcher=matcher):
            for batch, texts in slices(batches):
                more = []
                for before, text in zip(batch.column(hits).to_pylist(), texts):
                    own = [{"s": s, "e": s + len(matcher.block.spans[w]), "i": matcher.block.items[w]}
                           for s, w in matcher.find(words(text))]
                    more.append(before + own)
                kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("i", pa.list_(pa.string()))]))
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(more, kind)],
                                      ["doc_id", "text", hits])
        rows = saved(rows.mapInArrow(add, rows.schema), "hits")

    def run(batches):
        for batch, texts in slices(batches):
            all_hits = batch.column(hits).to_pylist()
            yield _result(batch.column("doc_id"), [len(words(t)) for t in texts],
                          [_covered([(h["s"], h["e"]) for h in own]) for own in all_hits],
                          [sorted({i for h in own for i in h["i"]}) for own in all_hits])

    return rows.mapInArrow(run, _schema(docs))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    columns = docs.columns
    count, each = matchers(docs, items)
    for matcher in each:
        def keep(batches, matcher=matcher):
            for batch, texts in slices(batches):
                yield batch.filter(pa.array([not matcher.find(words(t)) for t in texts], pa.bool_())).select(columns)
        docs = docs.mapInArrow(keep, docs.schema)
        if count > 1:
            docs = saved(docs, "clean")
    return docs
