"""Namespace-scoped vector search and near-duplicate checks; ``vector_index`` searches a stored index.

The store is scored where it lies. Each task turns its Arrow batches into matrices,
multiplies them with the query matrix of the same namespace and keeps only its best
``k`` rows per query, so what is shuffled is ``k`` rows per query and task. Query
sets too large to send to every task are met block by block instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from factstore.operators.cells import ROWS_PER_CELL, cells_for, fit_for, meeting, unit_rows
from factstore.operators.records import score_floor, with_scores
from factstore.operators.sizing import (
    MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, block_counts, block_of, broadcast_if_small, is_small, spread)
from factstore.schema import DUPLICATE_SCORE, SEARCH_LIMIT

ROWS_PER_BLOCK = 20_000
QUERIES_PER_PRODUCT, ROWS_PER_PRODUCT = 512, 4096
#: Rows of a batch whose vectors a task of the whole scan holds as doubles at a time.
ROWS_PER_SLICE = 1_000
MAX_PUSHED_NAMESPACES = 200
# Equal vectors must get equal scores wherever they sit in a matrix, so that ties
# go by id and results do not depend on how the table is partitioned.
SCORE_DIGITS = 12


class _Best:
    """The best ``k`` (score, id) of each query seen so far, ties by id."""

    def __init__(self, k: int):
        self.k = k
        self.scores: dict = {}
        self.ids: dict = {}

    def floor(self, query) -> float:
        kept = self.scores.get(query)
        return kept[-1] if kept is not None and len(kept) == self.k else -np.inf

    def offer(self, query, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            # Everything tied with the k-th best stays in, so that the id decides.
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= cut
            scores, ids = scores[near], ids[near]
        if query in self.scores:
            scores = np.concatenate([self.scores[query], scores])
            ids = np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]

    def table(self, query_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
        queries = [q for q, kept in self.scores.items() for _ in kept]
        ids = [i for kept in self.ids.values() for i in kept.tolist()]
        scores = [s for kept in self.scores.values() for s in kept.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(queries, query_type), pa.array(ids, id_type), pa.array(scores, pa.float64())],
            names=["query_id", "id", "score"])


def _score_into(best: _Best, query_ids: list, query_vectors: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Offer every (query, row) pair."""
    if vectors.shape[1] != query_vectors.shape[1]:
        return
    for start in range(0, len(query_ids), QUERIES_PER_PRODUCT):
        part = query_vectors[start:start + QUERIES_PER_PRODUCT]
        for at in range(0, len(vectors), ROWS_PER_PRODUCT):
            scores = np.round(vectors[at:at + ROWS_PER_PRODUCT] @ part.T, SCORE_DIGITS)
            tops = scores.max(axis=0)
            for j in range(len(part)):
                query = query_ids[start + j]
                floor = best.floor(query)
                if tops[j] >= floor:
                    near = np.flatnonzero(scores[:, j] >= floor)
                    best.offer(query, scores[near, j], ids[at + near])


def _values(column) -> np.ndarray:
    """Ids as numbers, or as plain objects where they are text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=object)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: doubles of a whole batch of long vectors would be many times the batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_SLICE):
            yield batch.slice(start, ROWS_PER_SLICE)


def _search_everywhere(store: DataFrame, asked: pa.Table, query_type: T.DataType, k: int) -> DataFrame:
    """Queries ``(query_id, user_id, embedding)`` sent to every task; the store is not shuffled."""
    query_ids, owners, embeddings = (asked.column(i).combine_chunks() for i in range(3))
    rows_of: dict = {}
    for row, user in enumerate(owners.to_pylist()):
        rows_of.setdefault(user, []).append(row)
    rows_of.pop(None, None)
    spaces = {}
    for user, rows in rows_of.items():
        mine = pa.array(rows, pa.int64())
        names = query_ids.take(mine).to_pylist()
        spaces[user] = [([names[i] for i in at], vectors) for vectors, at in unit_rows(embeddings.take(mine))]
    shared = store.sparkSession.sparkContext.broadcast(spaces)
    out = T.StructType([T.StructField("query_id", query_type),
                        T.StructField("id", store.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, types = _Best(k), None
        for batch in _slices(batches):
            users = batch.column(0).dictionary_encode()
            codes = users.indices.to_numpy(zero_copy_only=False)
            for code, user in enumerate(users.dictionary.to_pylist()):
                if user not in shared.value:
                    continue
                inside = batch.filter(pa.array(codes == code)) if len(users.dictionary) > 1 else batch
                ids = _values(inside.column(1))
                for vectors, at in unit_rows(inside.column(2)):
                    for query_ids, query_vectors in shared.value[user]:
                        _score_into(best, query_ids, query_vectors, ids[at], vectors)
            types = batch.column(1).type
        if types is not None and best.scores:
            yield best.table(query_arrow, types)

    query_arrow = query_ids.type
    scanned = store.select("user_id", "id", "embedding")
    if len(spaces) <= MAX_PUSHED_NAMESPACES:
        scanned = scanned.where(F.col("user_id").isin(*spaces) if spaces else F.lit(False))
    return scanned.mapInArrow(score, out)


def _search_by_block(store: DataFrame, queries: DataFrame, k: int, rows_per_block: int) -> DataFrame:
    """Every block of a namespace's rows meets every block of its queries.

    A namespace is cut into as many blocks as its size asks for (``block_counts``), so a
    namespace with a third of all rows becomes many groups of bounded size instead of one.
    """
    keys = ["user_id"]
    store_blocks = block_counts(store, keys, rows_per_block, "row_blocks")
    query_blocks = block_counts(queries, keys, rows_per_block, "query_blocks")
    asked = broadcast_if_small(queries.select("user_id").distinct())
    rows = store.select("user_id", "id", "embedding").join(asked, keys, "left_semi")
    rows = spread(spread(rows, store_blocks, keys, "row_blocks"), query_blocks, keys, "query_blocks")
    rows = rows.select("user_id", "id", "embedding", block_of("id", "row_blocks").alias("row_block"),
                       F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    asks = queries.select("query_id", "user_id", "embedding")
    asks = spread(spread(asks, store_blocks, keys, "row_blocks"), query_blocks, keys, "query_blocks")
    asks = asks.select("user_id", "query_id", "embedding", block_of("query_id", "query_blocks").alias("query_block"),
                       F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"))
    out = T.StructType([asks.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(k)
        if left.num_rows and right.num_rows:
            query_ids, ids = _values(left["query_id"]), _values(right["id"])
            asked_vectors = list(unit_rows(left["embedding"]))
            for vectors, at in unit_rows(right["embedding"]):
                for query_vectors, asked_at in asked_vectors:
                    _score_into(best, query_ids[asked_at].tolist(), query_vectors, ids[at], vectors)
        return pa.Table.from_batches([best.table(left["query_id"].type, right["id"].type)])

    # Fresh column identities, as queries are often derived from the store itself.
    asks = asks.select(*[F.col(c).alias(c) for c in asks.columns])
    cell = ["user_id", "row_block", "query_block"]
    return asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(score, out)


def rank_hits(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query; ties go to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_batch(store: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, min_score: float | None = 0.0,
                 include_scores: bool = True, max_query_bytes: int = MAX_BROADCAST_BYTES,
                 rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``(query_id, rank, id, score)`` for many queries ``(query_id, user_id, embedding)``.

    The floor applies after the limit, so fewer than ``k`` rows may come back.
    """
    small = queries.select("query_id", "user_id", "embedding")
    if is_small(small, max_query_bytes):
        scored = _search_everywhere(store, small.toArrow().combine_chunks(), small.schema["query_id"].dataType, k)
    else:
        scored = _search_by_block(store, small, k, rows_per_block)
    hits = score_floor(rank_hits(scored, k), min_score).select("query_id", "rank", "id", "score")
    return with_scores(hits, include_scores)


def search(store: DataFrame, query_vector: list[float], user_id: str, limit: int = SEARCH_LIMIT,
           min_score: float | None = 0.0, include_scores: bool = True) -> DataFrame:
    """One query against one namespace; the records themselves are joined back on."""
    asked = pa.table({"query_id": pa.array([0], pa.int64()), "user_id": [user_id],
                      "embedding": pa.array([[float(x) for x in query_vector]], pa.list_(pa.float64()))})
    scored = _search_everywhere(store, asked, T.LongType(), limit)
    # Each task sends its best rows, and the sort with a limit keeps the best of those.
    best = scored.orderBy(F.desc_nulls_last("score"), "id").limit(limit)
    hits = score_floor(rank_hits(best, limit), min_score).select("rank", "id", "score")
    return with_scores(with_records(hits, store.where(F.col("user_id") == user_id), limit), include_scores)


def with_records(hits: DataFrame, store: DataFrame, at_most: int | None = None) -> DataFrame:
    """Add the stored columns to hits, leaving the vectors behind.

    ``at_most`` is the number of hits there can be, ``k`` per query; within the bound
    they go to the scan. Without it the optimizer decides.
    """
    payload = store.drop("embedding", "score")
    if at_most is not None and at_most <= MAX_BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return hits.join(payload, "id")


def search_records(store: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, min_score: float | None = 0.0,
                   include_scores: bool = True, **options) -> DataFrame:
    """As ``search_batch``, with the stored columns of every hit.

    Ids are looked up within the query's namespace, as another one may hold the same id.
    """
    hits = search_batch(store, queries, k, min_score, True, **options)
    placed = hits.join(queries.select("query_id", "user_id"), "query_id")
    return with_scores(placed.join(store.drop("embedding", "score"), ["user_id", "id"]), include_scores)


def search_text(store: DataFrame, queries: DataFrame, encode, k: int = SEARCH_LIMIT,
                min_score: float | None = 0.0, include_scores: bool = True) -> DataFrame:
    """Search with query texts ``(query_id, user_id, query)``.

    ``encode`` adds the ``embedding`` column, for example a partial of ``embed``.
    """
    return search_batch(store, encode(queries), k, min_score, include_scores)


def near_duplicates(df: DataFrame, threshold: float = DUPLICATE_SCORE, rows_per_cell: int = ROWS_PER_CELL,
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Records that resemble an earlier one: ``(user_id, id, match_id, score)``.

    "Earlier" means a smaller id in the same namespace, as if each record were
    searched for before being added. Each flagged record gets one row, its best
    match, so a group of alike records gives one row per record and not one per pair.

    Equal vectors are folded into their first record before anything is compared:
    its copies match it with score one and it answers for them towards later rows.
    The rest is compared cell by cell: ``meeting`` sends each row to the pivots that the
    threshold's angle allows, and each pair to one of them; there are only so many cells that
    a row visits few others. A cell larger than a block is cut into blocks
    (``block_counts``) and every two of them meet in a group of their own. So the rows that
    are shuffled stay a small multiple of the store, while the pairs to compare may be all.
    """
    same = ["user_id", "_same"]
    # Two 64-bit hashes of the vector stand for it, so that ids alone are grouped.
    rows = (df.select("user_id", "id", "embedding")
            .where(F.exists("embedding", lambda x: x != 0))
            .withColumn("_same", F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))))
    repeated = (rows.groupBy(*same).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                .where(F.col("copies") > 1).select(*same, "first_id"))
    # A vector with very many copies is a skewed key, which adaptive execution splits.
    marked = rows.join(repeated, same, "left")
    singles = marked.where(F.col("first_id").isNull() | (F.col("id") == F.col("first_id"))).select("user_id", "id", "embedding")
    copies = (rows.drop("embedding").join(repeated, same).where(F.col("id") > F.col("first_id"))
              .select("user_id", "id", F.col("first_id").alias("match_id"), F.lit(1.0).alias("score")))

    pivots = fit_for(singles, cells_for(df.count(), rows_per_cell), threshold)
    cells = _paired(meeting(singles, pivots, threshold), rows_per_block)
    id_field = singles.schema["id"]
    out = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("id", id_field.dataType),
                        T.StructField("match_id", id_field.dataType), T.StructField("score", T.DoubleType())])
    cell = ["user_id", "cell", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if pending is None else pa.concat_tables([pending, table])
            starts = _runs(table, cell)
            # The last cell may go on in the next batch.
            pending = table.slice(starts[-1])
            if len(starts) > 1:
                yield from _best_earlier(table.slice(0, starts[-1]), starts[:-1], threshold).to_batches()
        if pending is not None:
            yield from _best_earlier(pending, np.array([0]), threshold).to_batches()

    # Cells arrive one after the other, so a task holds one large cell or many small ones.
    compared = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compare, out)
    return (compared.unionByName(copies)
            .groupBy("user_id", "id")
            .agg(F.min_by("match_id", F.struct(-F.col("score"), F.col("match_id"))).alias("match_id"),
                 F.max("score").alias("score"))
            .where(F.col("score") >= threshold))


def _paired(grouped: DataFrame, rows_per_block: int) -> DataFrame:
    """Rows of cells, once for each pair of blocks ``(low, high)`` that a row's ``block`` belongs to."""
    keys = ["user_id", "cell"]
    counts = block_counts(grouped, keys, rows_per_block, "blocks")
    placed = spread(grouped, counts, keys, "blocks").withColumn("block", block_of("id", "blocks"))
    # A row of block b visits cell (min(b, j), max(b, j)) for every block j.
    cells = placed.select(
        *keys, "id", "embedding", "home", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return cells.select(*keys, "id", "embedding", "home", "block",
                        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _runs(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Positions at which a new combination of the columns begins, in sorted rows."""
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[:1] = True
    for name in columns:
        column = table[name].combine_chunks()
        codes = column if pa.types.is_integer(column.type) else column.dictionary_encode().indices
        codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed)


class _Earlier:
    """The best match of each row of a cell, in the order of ids."""

    def __init__(self, rows: int):
        self.scores, self.at = np.full(rows, -np.inf), np.zeros(rows, np.int64)

    def offer(self, rows: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of each row with each of ``others``, which ascend; what may not match is -inf."""
        top = scores.argmax(axis=1)  # the first of equal scores is the smaller id
        score, other = scores[np.arange(len(rows)), top], others[top]
        better = (score > self.scores[rows]) | (score == self.scores[rows]) & (other < self.at[rows])
        self.scores[rows[better]], self.at[rows[better]] = score[better], other[better]


def _best_earlier(table: pa.Table, starts: np.ndarray, threshold: float) -> pa.Table:
    """Each row's best match among the smaller ids that it meets in its cell, if close enough."""
    users, all_ids, blocks = table["user_id"], _values(table["id"]), _values(table["block"])
    at_home = table["home"].combine_chunks().to_numpy(zero_copy_only=False)
    crossing = _values(table["low"]) != _values(table["high"])
    rows, earlier, best = [], [], []
    for all_vectors, at in unit_rows(table["embedding"]):
        of_cell = np.searchsorted(starts, at, side="right")
        edges = np.append(np.flatnonzero(np.diff(of_cell, prepend=0)), len(at))
        for c in np.flatnonzero(np.diff(edges) > 1):  # a row alone in its cell has nothing to match
            inside = slice(edges[c], edges[c + 1])
            order = np.argsort(all_ids[at[inside]], kind="stable")
            place = at[inside][order]
            vectors, ids, block = all_vectors[inside][order], all_ids[place], blocks[place]
            homes, guests = np.flatnonzero(at_home[place]), np.flatnonzero(~at_home[place])
            found = _Earlier(len(place))
            # Those at home meet each other; guests meet them, and either may be the earlier one.
            for asking, both in ((homes, False), (guests, True)):
                for start in range(0, len(asking), QUERIES_PER_PRODUCT):
                    some = asking[start:start + QUERIES_PER_PRODUCT]
                    met = homes if both else homes[:start + len(some)]
                    for first in range(0, len(met), ROWS_PER_PRODUCT):
                        others = met[first:first + ROWS_PER_PRODUCT]
                        scores = np.round(vectors[some] @ vectors[others].T, SCORE_DIGITS)
                        if crossing[place[0]]:
                            # Pairs within one block belong to that block's own cell.
                            scores[block[some, None] == block[None, others]] = -np.inf
                        before = others[None, :] < some[:, None]
                        found.offer(some, others, np.where(before, scores, -np.inf))
                        if both:
                            found.offer(others, some, np.where(before, -np.inf, scores).T)
            near = np.flatnonzero(found.scores >= threshold)
            rows += place[near].tolist()
            earlier += ids[found.at[near]].tolist()
            best += found.scores[near].tolist()
    picked = pa.array(rows, pa.int64())
    return pa.table({"user_id": users.take(picked), "id": table["id"].take(picked),
                     "match_id": pa.array(earlier, table["id"].type), "score": pa.array(best, pa.float64())})
