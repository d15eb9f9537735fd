"""A stored index of vectors by cells, which a search opens only as far as angles demand.

The index lies beside the store: its rows in a directory for each cell, sorted by namespace
and by angle to the cell's pivot, and a small table that says how many rows of a namespace a
cell holds and between which angles. A search first opens the nearest cells that together
hold ``k`` rows. The ``k``-th score so far bounds the answer, and only cells that may hold a
better row are opened then; of those, only rows whose angle may still do. So the hits are
those of the exact search, however few cells are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factstore.operators.cells import APART, ROWS_PER_CELL, SLACK, Pivots, angle_of, cells_for, fit, placed, unit_rows
from factstore.operators.records import score_floor, with_scores
from factstore.operators.search import _Best, _score_into, _values, rank_hits
from factstore.operators.sizing import MAX_BROADCAST_BYTES, measure
from factstore.schema import SEARCH_LIMIT
from factstore.session import shared_folder

#: Queries times cells that the driver weighs at a time.
MOST_WEIGHED = 2_000_000


def write_index(store: DataFrame, path: str, rows_per_cell: int = ROWS_PER_CELL) -> None:
    """Index every row of ``store`` (``id, user_id, embedding``) with a usable vector below ``path``.

    Pivots come from a bounded sample; a cell with many rows is spread over several files.
    """
    spark, rows = store.sparkSession, store.select("user_id", "id", "embedding")
    pivots = fit(rows, cells_for(store.count(), rows_per_cell))
    (placed(rows, pivots).hint("rebalance", "cell").sortWithinPartitions("cell", "user_id", "angle")
     .write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows"))
    (_rows(spark, path, rows.schema).groupBy("user_id", "cell")
     .agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
     .sort("user_id").write.mode("errorifexists").parquet(f"{path}/cells"))
    rows.limit(0).write.mode("errorifexists").parquet(f"{path}/shape")
    # Written last: an index without its pivots is not finished.
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pivots.vectors)], "cell int, pivot array<double>") \
        .coalesce(1).write.mode("errorifexists").parquet(f"{path}/pivots")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    return spark.read.schema(full).parquet(f"{path}/rows")


@dataclass
class _Asked:
    """Queries of one slice on the driver, with what the index says about each one's cells."""
    ids: list
    owners: list
    vectors: list
    angles: np.ndarray
    cells: dict

    def nearest(self, k: int) -> dict[int, list[int]]:
        """For each query the cells of its namespace, most promising first, until they hold ``k`` rows."""
        out = {}
        for q, owner in enumerate(self.owners):
            held, chosen = 0, []
            for _, cell, n in sorted(((self._best(q, c, low, high), c, n) for c, n, low, high in self._own(q)), key=lambda x: x[:2]):
                chosen.append(cell)
                held += n
                if held >= k:
                    break
            out[q] = chosen
        return out

    def open(self, floors: np.ndarray, done: dict[int, list[int]]) -> dict[int, list[int]]:
        """The cells that may hold a row at or above a query's floor and were not read yet."""
        return {q: [c for c, _, low, high in self._own(q)
                    if c not in done[q] and np.cos(self._best(q, c, low, high)) >= floors[q] - SLACK]
                for q in range(len(self.ids))}

    def _own(self, q: int) -> list[tuple]:
        size_apart = self.angles[q] is None
        return [c for c in self.cells.get(self.owners[q], ()) if (c[0] == APART) == size_apart]

    def _best(self, q: int, cell: int, low: float, high: float) -> float:
        """The smallest angle that a row of the cell may have to the query."""
        if cell == APART:
            return 0.0
        angle = self.angles[q][cell]
        return max(0.0, angle - high - SLACK, low - angle - SLACK)


def read_pivots(spark: SparkSession, path: str) -> Pivots:
    return Pivots(np.array([r["pivot"] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()]))


def _asked(spark: SparkSession, path: str, pivots: Pivots, part: pa.Table) -> _Asked:
    ids, owners, vectors, angles = [], [], [], []
    names, users = part.column("query_id").to_pylist(), part.column("user_id").to_pylist()
    for found, at in unit_rows(part.column("embedding")):
        near = pivots.angles(found) if pivots.fits(found) else [None] * len(at)
        for i, row in enumerate(at.tolist()):
            if users[row] is not None:
                ids.append(names[row])
                owners.append(users[row])
                vectors.append(found[i])
                angles.append(near[i])
    stats = spark.read.parquet(f"{path}/cells").select("user_id", "cell", "n", "low", "high")
    if len(set(owners)) <= 200:
        stats = stats.where(F.col("user_id").isin(*set(owners)) if owners else F.lit(False))
    cells: dict = {}
    for r in stats.collect() if owners else ():
        cells.setdefault(r["user_id"], []).append((r["cell"], r["n"], r["low"], r["high"]))
    return _Asked(ids, owners, vectors, angles, cells)


def _plan(asked: _Asked, chosen: dict[int, list[int]], floors: np.ndarray) -> tuple[dict, dict]:
    """What tasks get: each namespace's queries by size of vector, and for each of its cells their places and a ring.

    A query's vector is in it once, however many cells the query opens.
    """
    asking, place = {}, {}
    for q, (owner, vector) in enumerate(zip(asked.owners, asked.vectors)):
        if chosen.get(q):
            own = asking.setdefault(owner, {}).setdefault(len(vector), [])
            place[q] = len(own)
            own.append(q)
    wanted: dict = {}
    for q, cells in chosen.items():
        for cell in cells:
            wanted.setdefault((asked.owners[q], cell), []).append(q)
    reach = angle_of(np.clip(floors, -1, 1)) + 2 * SLACK
    plan = {}
    for (owner, cell), queries in wanted.items():
        by_size: dict = {}
        for q in queries:
            by_size.setdefault(len(asked.vectors[q]), []).append(place[q])
        # A row outside this ring is too far from every query of the group.
        ring = None if cell == APART else (min(asked.angles[q][cell] - reach[q] for q in queries),
                                           max(asked.angles[q][cell] + reach[q] for q in queries))
        plan[owner, cell] = {size: np.array(at, np.int32) for size, at in by_size.items()}, ring
    vectors = {owner: {size: ([asked.ids[q] for q in own], np.array([asked.vectors[q] for q in own])) for size, own in by_size.items()}
               for owner, by_size in asking.items()}
    return vectors, plan


def _scan(rows: DataFrame, asked: _Asked, chosen: dict[int, list[int]], floors: np.ndarray, k: int, query_type: T.DataType) -> DataFrame:
    """The best ``k`` of each query in each task, from the chosen cells alone."""
    vectors, plan = _plan(asked, chosen, floors)
    shared = rows.sparkSession.sparkContext.broadcast((vectors, plan))
    query_arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(query_type, pa.string())
    out = T.StructType([T.StructField("query_id", query_type), T.StructField("id", rows.schema["id"].dataType),
                        T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, types = _Best(k), None
        asking, plan = shared.value
        for batch in batches:
            types = batch.schema.field("id").type
            users, cells = batch.column("user_id").to_pylist(), batch.column("cell").to_pylist()
            keys = list(zip(users, cells))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b or keys[a] not in plan:
                    continue
                places, ring = plan[keys[a]]
                own = batch.slice(a, b - a)
                if ring is not None:
                    angle = own.column("angle").to_numpy(zero_copy_only=False)
                    own = own.filter(pa.array((angle >= ring[0]) & (angle <= ring[1])))
                ids = _values(own.column("id"))
                for vectors, at in unit_rows(own.column("embedding")):
                    places_of = places.get(vectors.shape[1], ())
                    if len(places_of):
                        names, asked_vectors = asking[users[a]][vectors.shape[1]]
                        _score_into(best, [names[i] for i in places_of], asked_vectors[places_of], ids[at], vectors)
        if types is not None and best.scores:
            yield best.table(query_arrow, types)

    opened = sorted({cell for _, cell in plan})
    found = rows.where(F.col("cell").isin(*opened) if opened else F.lit(False))
    owners = {owner for owner, _ in plan}
    if owners and len(owners) <= 200:
        found = found.where(F.col("user_id").isin(*owners))
    return found.select("user_id", "id", "embedding", "angle", "cell").mapInArrow(score, out)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = SEARCH_LIMIT, min_score: float | None = 0.0,
                 include_scores: bool = True, max_query_bytes: int = MAX_BROADCAST_BYTES, opened: list | None = None) -> DataFrame:
    """``(query_id, rank, id, score)`` as ``search_batch`` over the indexed rows, reading few of them.

    Queries are taken in slices that the driver weighs against the table of cells; each slice
    costs two scans of the cells it needs. ``opened`` collects the cells each scan asked for.
    """
    rows, pivots = _rows(spark, path, spark.read.parquet(f"{path}/shape").schema), read_pivots(spark, path)
    small = queries.select("query_id", "user_id", "embedding")
    n, size = measure(small)
    slices = max(1, -(-size // max_query_bytes), -(-n * len(pivots.vectors) // MOST_WEIGHED))
    query_type, found = small.schema["query_id"].dataType, []
    part_of = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    for part in range(slices):
        asked = _asked(spark, path, pivots, (small if slices == 1 else small.where(part_of == part)).toArrow().combine_chunks())
        lowest = np.full(len(asked.ids), -1.0 if not min_score else float(min_score))
        first = asked.nearest(k)
        place = shared_folder(spark, "index-hits")
        _scan(rows, asked, first, np.full(len(asked.ids), -1.0), k, query_type).write.parquet(place)
        near = rank_hits(spark.read.parquet(place), k)
        place_of = {q: i for i, q in enumerate(asked.ids)}
        for r in near.where(F.col("rank") == k).select("query_id", "score").collect():  # a row for each query of the slice
            lowest[place_of[r["query_id"]]] = max(lowest[place_of[r["query_id"]]], r["score"])
        rest = asked.open(lowest, first)
        if opened is not None:
            opened += [{c for cells in first.values() for c in cells}, {c for cells in rest.values() for c in cells}]
        found.append(near.select("query_id", "id", "score"))
        if any(rest.values()):
            found.append(_scan(rows, asked, rest, lowest, k, query_type))
    scored = found[0]
    for more in found[1:]:
        scored = scored.unionByName(more)
    return with_scores(score_floor(rank_hits(scored, k), min_score).select("query_id", "rank", "id", "score"), include_scores)
