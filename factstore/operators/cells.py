"""Cells of unit vectors around pivots, and what the triangle inequality says about them.

A row lies in the cell of its nearest pivot. Angles between unit vectors are a metric, so a
row's angle to a pivot bounds its angle to every row of the pivot's cell; what the bounds
exclude need not be read or compared, and nothing else is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Rows that pivots are chosen from, by a hash of their ids, and cells at most.
SAMPLE, MOST_CELLS = 8_192, 512
#: Rows of a cell that a table of them is cut for.
ROWS_PER_CELL = 5_000
#: Angles are computed to better than this.
SLACK = 1e-6
#: The cell of rows whose vectors have another size than the pivots; nothing is known of their angles.
APART = -1
_ROUNDS = 4
#: Cells that a row visits on average, at most, when rows are sent to meet.
MOST_VISITS = 2


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors (double) with the positions of their rows, once per vector size.

    Rows without a vector or with a zero vector are left out: there is nothing to
    score them with.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        flat = (column if len(rows) == len(column) else column.take(pa.array(rows))).flatten()
        matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
        lengths = np.linalg.norm(matrix, axis=1)
        good = lengths > 0
        if good.any():
            yield matrix[good] / lengths[good, None], rows[good]


def angle_of(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass(frozen=True)
class Pivots:
    """Unit vectors, one for each cell."""
    vectors: np.ndarray

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        """From each of the unit vectors to each pivot."""
        return angle_of(vectors @ self.vectors.T)

    def fits(self, vectors: np.ndarray) -> bool:
        return vectors.shape[1] == self.vectors.shape[1]


def cells_for(rows: int, rows_per_cell: int = ROWS_PER_CELL) -> int:
    return min(MOST_CELLS, max(1, -(-rows // rows_per_cell)))


def fit(df: DataFrame, cells: int, sample: int = SAMPLE) -> Pivots:
    """Pivots by spherical k-means over at most ``sample`` rows, chosen by a hash of the id.

    They are vectors of the size that most rows of the sample have. Any pivots give right
    results; these keep alike rows together.
    """
    chosen = (df.where(F.exists("embedding", lambda x: x != 0)).select("id", "embedding")
              .orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow())
    parts = [vectors for vectors, _ in unit_rows(chosen.column("embedding"))]
    if not parts:
        return Pivots(np.ones((1, 1)))
    vectors = max(parts, key=len)
    centers = np.unique(vectors, axis=0)
    if len(centers) > cells:
        centers = centers[np.sort(np.random.default_rng(7).choice(len(centers), cells, replace=False))]
        for _ in range(_ROUNDS):
            nearest = (vectors @ centers.T).argmax(1)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, vectors)
            lengths = np.linalg.norm(sums, axis=1)
            filled = lengths > 1e-9
            centers[filled] = sums[filled] / lengths[filled, None]
    return Pivots(centers)


def placed(df: DataFrame, pivots: Pivots) -> DataFrame:
    """``df`` (with ``embedding``) with the ``cell`` of each usable row and its ``angle`` to the pivot."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vectors, at in unit_rows(batch.column("embedding")):
                if pivots.fits(vectors):
                    cosines = vectors @ pivots.vectors.T
                    cell = cosines.argmax(1)
                    angle = angle_of(cosines[np.arange(len(cell)), cell])
                else:
                    cell, angle = np.full(len(at), APART), np.zeros(len(at))
                own = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
                yield pa.record_batch([*own.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*columns, "cell", "angle"])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def _visits(df: DataFrame, pivots: Pivots, threshold: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Says of unit vectors their cells, and of all cells whether they visit them (see ``meeting``)."""
    near = float(angle_of(threshold)) + SLACK
    radius = np.full(len(pivots.vectors), -np.inf)
    found = placed(df.select("user_id", "id", "embedding"), pivots).where("cell >= 0")
    for row in found.groupBy("cell").agg(F.max("angle").alias("r")).collect():
        radius[row["cell"]] = row["r"]

    def visits(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angles = pivots.angles(own)
        cell = angles.argmin(1)
        reach = np.minimum(angles[np.arange(len(own)), cell][:, None] + 2 * near, radius[None, :] + near) + SLACK
        return cell, (angles <= reach) & (np.arange(angles.shape[1])[None, :] < cell[:, None])

    return visits


def fit_for(df: DataFrame, cells: int, threshold: float) -> Pivots:
    """Pivots for ``meeting``: at most ``cells``, and so few that a row visits ``MOST_VISITS`` others on average.

    Where angles exclude little, more cells save no comparison and only copy the rows. All
    rows are asked, without sending any; the next try follows from their count.
    """
    while True:
        pivots = fit(df, cells)
        visits = _visits(df, pivots, threshold)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = visited = 0
            for batch in batches:
                for vectors, at in unit_rows(batch.column("embedding")):
                    for start in range(0, len(at) if pivots.fits(vectors) else 0, 1000):
                        own = vectors[start:start + 1000]
                        rows, visited = rows + len(own), visited + int(visits(own)[1].sum())
            yield pa.record_batch([pa.array([rows], pa.int64()), pa.array([visited], pa.int64())], ["rows", "visited"])

        if len(pivots.vectors) == 1:
            return pivots
        all_rows, visited = df.select("embedding").mapInArrow(run, "rows bigint, visited bigint").agg(
            F.sum("rows"), F.sum("visited")).first()
        if (visited or 0) <= MOST_VISITS * (all_rows or 0):
            return pivots
        cells = max(1, min(len(pivots.vectors) - 1, int(len(pivots.vectors) * MOST_VISITS * all_rows / visited)))


def meeting(df: DataFrame, pivots: Pivots, threshold: float) -> DataFrame:
    """``user_id, id, embedding, cell, home``: every usable row in its own cell and in those it visits.

    Two rows within the threshold's angle meet in the smaller of their cells, which is home
    to one of them: a row visits a smaller cell only if a row of it may be that near. By the
    triangle inequality the cell's pivot is then no farther than the cell's radius plus that
    angle, nor than the row's own pivot plus twice the angle.
    """
    rows, visits = df.select("user_id", "id", "embedding"), _visits(df, pivots, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vectors, at in unit_rows(batch.column("embedding")):
                for start in range(0, len(at), 1000):
                    own, place = vectors[start:start + 1000], at[start:start + 1000]
                    row, cell = np.arange(len(place)), np.full(len(place), APART)
                    home = np.ones(len(place), bool)
                    if pivots.fits(own):
                        cell, visited = visits(own)
                        guest, visited = np.nonzero(visited)
                        row, cell = np.concatenate([row, guest]), np.concatenate([cell, visited])
                        home = np.concatenate([home, np.zeros(len(guest), bool)])
                    for part in range(0, len(row), 4000):
                        taken = batch.take(pa.array(place[row[part:part + 4000]]))
                        yield pa.record_batch([*taken.columns, pa.array(cell[part:part + 4000], pa.int32()), pa.array(home[part:part + 4000])],
                                              ["user_id", "id", "embedding", "cell", "home"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())]))


def comparisons(met: DataFrame) -> int:
    """Pairs that meet: those at home in a cell, and its rows with its visitors."""
    counted = met.groupBy("user_id", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    return counted.agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("v")).cast("bigint")).first()[0] or 0
