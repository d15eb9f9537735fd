"""Ranked lexical search of many items at once, by common subexpressions of their term sums.

An item's score for a document is a sum over the item's terms, so what items share need be
summed once. Term sets that several items hold are mined first: the two sets with the most
in common give a node for their common part, every set that holds it whole takes the node
instead, and so on until no two sets share two places. Nodes may hold nodes, which makes a
graph. For each slice of documents the terms' contributions are laid out once, the nodes'
partial accumulators are summed in the order of the graph, and each item adds up what is
left of its set.

Documents are read once for a block of items: that pass counts, over all documents, how many
have terms, all their terms and how many documents hold each of the block's terms, and keeps
the counts of the block's terms for each document in the shared folder. A second pass over
these small rows scores. A task keeps the best ``k`` of each item; these are ranked among
groups of tasks first, so that no group grows with the number of tasks. Items are taken in
blocks of bounded size, each with its two passes.

Terms are the runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. A null or empty text has none and is never ranked. Rows of ``documents`` are
documents, repeated ones among them; equal scores go by ascending ``doc_id``, null last. Rows
with one ``item_id`` (null among them) are one item with the terms of all. An item without a
term, or whose terms no document holds, has no rows, and empty tables give an empty result.
Extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from factstore.llm.common import saved, slices

K = 50
#: Bytes of items and their terms in a block, and items whose sets are mined together.
BLOCK_BYTES, MINED_TOGETHER = 8_000_000, 256
#: Accumulator cells that a task holds at a time.
CELLS = 4_000_000
#: Groups of tasks whose best rows are ranked before all are.
TASK_GROUPS = 256

#: ASCII letters become small, other ASCII characters that are no digits a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, each pair once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [sorted(set(terms(t))) for t in texts]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.record_batch([batch.column("item_id").take(at), pa.array([t.decode() for f in found for t in f], pa.string())],
                                  ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string").distinct()


class Shared:
    """The graph of sums: ``nodes`` in order, each of cells below it, and ``sums`` of the given sets.

    A place held by one set alone belongs to ``owner``. The places that several sets hold
    have the first cells, the nodes the following ones.
    """

    def __init__(self, sets: list[np.ndarray], size: int):
        holders = np.bincount(np.concatenate([*sets, np.zeros(0, np.int64)]), minlength=size)
        self.owner = np.full(size, -1)
        for row, own in enumerate(sets):
            self.owner[own[holders[own] == 1]] = row
        self.cell = np.where(holders > 1, np.cumsum(holders > 1) - 1, -1)
        self.leaves, self.rows, most = int((holders > 1).sum()), len(sets), 3 * len(sets)
        # One row for each set and node, one column for each shared place and each node.
        holds = np.zeros((len(sets) + most, self.leaves + most), np.float32)
        for row, own in enumerate(sets):
            holds[row, self.cell[own[holders[own] > 1]]] = 1
        rows, columns = len(sets), self.leaves
        common = holds[:, :columns] @ holds[:, :columns].T
        np.fill_diagonal(common, 0)
        while rows < len(holds):
            a, b = divmod(int(common[:rows, :rows].argmax()), rows)
            if common[a, b] < 2:
                break
            part = np.flatnonzero(holds[a] * holds[b])
            whole = np.flatnonzero(holds[:rows, part].sum(1) == len(part))
            holds[np.ix_(whole, part)] = 0
            holds[whole, columns] = 1
            holds[rows, part] = 1
            rows, columns = rows + 1, columns + 1
            changed = np.append(whole, rows - 1)
            counts = holds[changed, :columns] @ holds[:rows, :columns].T
            common[changed, :rows], common[:rows, changed] = counts, counts.T
            common[changed, changed] = 0
        found = [np.flatnonzero(own) for own in holds[:rows]]
        self.sums = found[:len(sets)]
        self.nodes = self._in_order(found[len(sets):])

    def _in_order(self, below: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
        """Nodes with those that they hold before them."""
        done, out = set(), []
        for first in range(len(below)):
            trail = [first]
            while trail:
                open_ = [c - self.leaves for c in below[trail[-1]].tolist() if c >= self.leaves and c - self.leaves not in done]
                if open_:
                    trail += open_
                    continue
                node = trail.pop()
                if node not in done:
                    done.add(node)
                    out.append((self.leaves + node, below[node]))
        return out

    @property
    def additions(self) -> int:
        return sum(max(0, len(own) - 1) for own in [*self.sums, *(below for _, below in self.nodes)])

    def scores(self, at: np.ndarray, column: np.ndarray, values: np.ndarray, documents: int) -> np.ndarray:
        """Sums of all sets for each document, from contributions ``values`` at (place, document)."""
        cells = np.zeros((self.leaves + len(self.nodes), documents), np.int64)
        out = np.zeros((self.rows, documents), np.int64)
        owner, cell = self.owner[at], self.cell[at]
        own, many = owner >= 0, cell >= 0
        np.add.at(out, (owner[own], column[own]), values[own])
        cells[cell[many], column[many]] = values[many]
        for node, below in self.nodes:
            cells[node] = cells[below].sum(0)
        for row, held in enumerate(self.sums):
            if len(held):
                out[row] += cells[held].sum(0)
        return out


class Block:
    """Items of a block and their terms; items that may share much are mined together."""

    def __init__(self, rows: list[tuple]):
        words = sorted({t for _, t in rows})
        self.number = {t.encode(): i for i, t in enumerate(words)}
        own: dict = {}
        for item, term in rows:
            own.setdefault(item, []).append(self.number[term.encode()])
        self.items = sorted(own, key=lambda i: (min(own[i]), i is None, i))
        groups = [self.items[i:i + MINED_TOGETHER] for i in range(0, len(self.items), MINED_TOGETHER)]
        self.groups = []
        for group in groups:
            used = np.unique(np.concatenate([own[i] for i in group]))
            sets = [np.searchsorted(used, np.sort(own[i])) for i in group]
            self.groups.append((used, Shared(sets, len(used))))


def _counted(docs: DataFrame, block: Block, label: str) -> DataFrame:
    """Counts of the block's terms for each document that has some, and a row of statistics of each task."""
    number, size = block.number, len(block.number)
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["doc_id", "n", "terms", "counts", "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, stats, id_type = number.get, np.zeros(size + 2, np.int64), None
        for batch, texts in slices(batches):
            id_type, sizes, owner, found = batch.schema.field("doc_id").type, [], [], []
            for row, text in enumerate(texts):
                own = terms(text)
                sizes.append(len(own))
                known = [i for i in map(get, own) if i is not None]
                found += known
                owner += [row] * len(known)
            sizes = np.array(sizes, np.int64)
            pairs, counts = np.unique(np.array(owner, np.int64) * size + np.array(found, np.int64), return_counts=True) \
                if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows, place = np.divmod(pairs, size)
            stats[:2] += (sizes > 0).sum(), sizes.sum()
            stats[2:] += np.bincount(place, minlength=size)
            some, starts = np.unique(rows, return_index=True)
            offsets = pa.array([*starts, len(rows)], pa.int32())
            yield pa.record_batch([
                batch.column("doc_id").take(pa.array(some, pa.int64())), pa.array(sizes[some], kinds[0]),
                pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())), pa.nulls(len(some), kinds[3])], names)
        if id_type is not None:
            yield pa.record_batch([pa.nulls(1, id_type), *(pa.nulls(1, k) for k in kinds[:3]),
                                   pa.array([stats.tolist()], kinds[3])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, terms array<int>, counts array<int>, stats array<bigint>"
    return saved(docs.select("doc_id", "text").mapInArrow(run, schema), label)


def _weights(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all terms, and each term's weight."""
    totals = np.zeros(size + 2, np.int64)
    found = (counted.where("stats IS NOT NULL").select(F.posexplode("stats").alias("at", "n"))
             .groupBy("at").agg(F.sum("n").alias("n")))
    for row in found.toLocalIterator():  # one row for each term of the block
        totals[row["at"]] = row["n"]
    documents, every = int(totals[0]), int(totals[1])
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in totals[2:].tolist()]
    return documents, every, np.array(weights, np.int64)


def _lengths(n: np.ndarray, documents: int, every: int) -> np.ndarray:
    """What a document's length counts against it; whole numbers of any size."""
    if len(n) and int(n.max()) * 50 * documents >= 1 << 62:
        n = n.astype(object)
    return (50 + (50 * n * documents) // every).astype(np.int64)


class _Best:
    """The best ``k`` documents of each item that a task has met."""

    def __init__(self, items: int, k: int):
        self.k, self.held, self.waiting = k, [], 0
        self.floor = np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, doc_ids: pa.Array, first: int) -> None:
        item, column = np.nonzero(scores >= self.floor[first:first + len(scores), None])
        if len(item):
            self.held.append(pa.table({"item": pa.array(item + first, pa.int32()), "score": pa.array(scores[item, column]),
                                       "doc_id": doc_ids.take(pa.array(column))}))
            self.waiting += len(item)
            if self.waiting > 4 * self.k * len(self.floor):
                self.fold()

    def fold(self) -> pa.Table | None:
        if not self.held:
            return None
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
        item = rows["item"].to_numpy()
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        rows = rows.filter(pa.array(place < self.k))
        full = rows.filter(pa.array(place[place < self.k] == self.k - 1))
        # An equal score may still win by its id.
        self.floor[full["item"].to_numpy()] = full["score"].to_numpy()
        self.held, self.waiting = [rows], len(rows)
        return rows


def _scored(counted: DataFrame, block: Block, k: int) -> DataFrame:
    """``item`` (its place in the block), ``doc_id, score, part``: the best rows of each task."""
    documents, every, weights = _weights(counted, len(block.number))
    groups, n_items = block.groups, len(block.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part = _Best(n_items, k), TaskContext.get().partitionId() % TASK_GROUPS
        widest = max(shared.leaves + len(shared.nodes) + shared.rows for _, shared in groups)
        at_once = max(16, CELLS // widest)
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                lists = batch.column("terms")
                place = lists.flatten().to_numpy(zero_copy_only=False)
                tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                column = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                length = _lengths(batch.column("n").to_numpy(zero_copy_only=False), documents, every)[column]
                value = weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length))
                first = 0
                for used, shared in groups:
                    own = np.minimum(np.searchsorted(used, place), len(used) - 1)
                    here = used[own] == place
                    best.offer(shared.scores(own[here], column[here], value[here], batch.num_rows),
                               batch.column("doc_id"), first)
                    first += shared.rows
        rows = best.fold()
        if rows is not None:
            rows = rows.append_column("part", pa.array(np.full(len(rows), part), pa.int32()))
            yield from rows.select(["item", "doc_id", "score", "part"]).to_batches()

    kind = counted.schema["doc_id"].dataType.simpleString()
    return (counted.where("n IS NOT NULL").select("doc_id", "n", "terms", "counts")
            .mapInArrow(run, f"item int, doc_id {kind}, score bigint, part int"))


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    pairs = saved(item_terms(items), "item-terms")
    size = pairs.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item_id"), F.lit(count))
    id_type = items.schema["item_id"].dataType.simpleString()
    out = []
    for at in range(count):
        rows = [tuple(r) for r in pairs.where(part == at).collect()]
        if not rows:
            continue
        block = Block(rows)
        scored = _scored(_counted(docs, block, "term-counts"), block, k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", "part"], ["item"]):
            place = Window.partitionBy(*keys).orderBy(*order)
            scored = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {id_type}")
        out.append(scored.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id {kind}, score bigint")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
