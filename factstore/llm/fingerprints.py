"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has an entropy level. Levels are ranked by how rare they
are among all windows of all documents. Of each ``NEIGHBOURS`` neighbouring windows the
one with the rarest level (the leftmost of equals) gets a vote, and windows with at least
``VOTES`` votes are features, besides the rarest window of each text. Features enter a chain of
Bloom filters of ``FILTER_BITS`` bits, ``PER_FILTER`` in each. Two chains are compared
filter by filter: the bits two filters share, less what chance explains, as a part of the
most they could share; the best partner of each filter of the shorter chain counts, and
the mean over its filters is the likeness.

A text shorter than a window is one feature. An empty or null text has none; it is like
another without features (1) and unlike all others (0). The next document follows in
descending order of ``doc_id`` (nulls last, ties by descending digest of the text), after
the last comes the first, and a single document follows itself. Repeated rows follow each
other. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factstore.llm.common import SLICE_BYTES, slices

WINDOW, NEIGHBOURS, VOTES = 32, 32, 8
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
LEVELS = 1000
CUTOFF = 0.1
_PIECE = 200_000
_ONE = 1 << 16
_BITS = np.log2(WINDOW)


def _growth() -> np.ndarray:
    """What one more equal byte adds to the sum of n log2 n, in fixed point."""
    n = np.arange(WINDOW + 1, dtype=float)
    total = np.round(n * np.log2(np.maximum(n, 1)) * _ONE).astype(np.int64)
    return np.diff(total)


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte, 0 to ``LEVELS`` - 1."""
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    later, earlier = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        later[:-d] += same
        earlier[d:] += same
    growth = _growth()
    # The sum of the first window, then what leaves and what comes with every step.
    first = growth[np.minimum(earlier[:WINDOW], WINDOW - 1)].sum()
    steps = growth[earlier[WINDOW:]] - growth[later[:n - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(steps)])
    whole = int(_BITS * WINDOW * _ONE)
    return np.minimum((whole - total) * LEVELS // whole, LEVELS - 1)


def _pieces(bounds: np.ndarray, reach: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Cut joined texts into pieces (start, end, end with ``reach`` more bytes) with the end of each byte's text."""
    total = int(bounds[-1])
    for start in range(0, total, _PIECE):
        end, stop = min(total, start + _PIECE), min(total, start + _PIECE + reach)
        a, b = np.searchsorted(bounds, [start, stop - 1], side="right")
        cuts = np.clip(bounds[a - 1:b + 1], start, stop)
        yield start, end, stop, np.repeat(bounds[a:b + 1], np.diff(cuts))


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level by its windows in all documents, the rarest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for _, texts in slices(batches):
            x, bounds = _join([t.encode() for t in texts])
            for start, end, stop, ends in _pieces(bounds, WINDOW - 1) if len(x) else ():
                levels = entropy_levels(x[start:stop])[:end - start]
                inside = np.arange(start, start + len(levels)) + WINDOW <= ends[:len(levels)]
                counts += np.bincount(levels[inside], minlength=LEVELS)
        yield pa.record_batch([pa.array(range(LEVELS), pa.int32()), pa.array(counts)], ["level", "n"])

    found = docs.select("text").mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS, np.int64)
    for level, n in found.collect():  # one row for each level
        counts[level] = n
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort([np.arange(LEVELS), counts])] = np.arange(LEVELS)
    return ranks


def features(x: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the selected windows in joined texts."""
    total = len(x)
    votes = np.zeros(total, np.int32)
    rarest = np.full(len(bounds) - 1, np.iinfo(np.int64).max)
    none = np.iinfo(np.int64).max
    for start, end, stop, ends in _pieces(bounds, WINDOW + NEIGHBOURS - 2) if total else ():
        levels = entropy_levels(x[start:stop])
        at = np.arange(start, start + len(levels))
        inside = at + WINDOW <= ends[:len(levels)]
        key = np.where(inside, ranks[levels] << 40 | at, none)
        own = key[:end - start]
        # The rarest window of each text that reaches into the piece.
        a, b = np.searchsorted(bounds, [start, end - 1], side="right")
        if len(own):
            texts = np.arange(a - 1, b)
            cuts = np.clip(bounds[texts] - start, 0, len(own))
            some = cuts < np.clip(bounds[texts + 1] - start, 0, len(own))
            np.minimum.at(rarest, texts[some], np.minimum.reduceat(own, cuts[some]))
        best, width = key, 1
        while width < NEIGHBOURS and len(best) > width:
            step = min(width, NEIGHBOURS - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        if width == NEIGHBOURS and len(best):
            best = best[:end - start]
            whole = at[:len(best)] + WINDOW + NEIGHBOURS - 1 <= ends[:len(best)]
            winners = best[whole] & ((1 << 40) - 1)
            if len(winners):
                low = int(winners.min())
                counted = np.bincount(winners - low)
                votes[low:low + len(counted)] += counted.astype(np.int32)
    rarest = rarest[rarest != none] & ((1 << 40) - 1)
    return np.union1d(np.flatnonzero(votes >= VOTES), rarest)


def _hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of ``WINDOW`` bytes."""
    lanes = np.ascontiguousarray(windows).view("<u8").astype(np.uint64)
    h = np.full(len(lanes), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(lanes.shape[1]):
        h = (h ^ lanes[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text, as rows of bytes."""
    x, bounds = _join(texts)
    at = features(x, bounds, ranks)
    hashes = _hashes(x[at[:, None] + np.arange(WINDOW)]) if len(at) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(at, bounds)
    out = []
    for i, text in enumerate(texts):
        own = hashes[cuts[i]:cuts[i + 1]]
        if 0 < len(text) < WINDOW:
            own = _hashes(np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint8)[None, :]) + np.uint64(len(text))
        _, first = np.unique(own, return_index=True)
        own = own[np.sort(first)]
        filters = -(-len(own) // PER_FILTER)
        bits = np.zeros((filters, FILTER_BITS), bool)
        for k in range(HASHES):
            bits[np.arange(len(own)) // PER_FILTER, ((own >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
        out.append(np.packbits(bits, axis=1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean best overlap of the filters of the shorter chain, normalised to 0 to 1."""
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    size_b, total = np.bitwise_count(b).sum(1, dtype=np.int64), 0.0
    for row in a:
        size = int(np.bitwise_count(row).sum())
        shared = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        most = np.minimum(size, size_b)
        chance = size * size_b / FILTER_BITS
        floor = np.minimum(CUTOFF * (most - chance) + chance, most - 1e-9)
        total += float(np.clip((shared - floor) / (most - floor), 0, 1).max())
    return total / len(a)


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _place(column: Column, bounds: list[int], first: int = 0) -> Column:
    """How many bounds are at or below the column, by a search tree of comparisons."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return (F.when(column < bounds[middle], _place(column, bounds[:middle], first))
            .otherwise(_place(column, bounds[middle + 1:], first + middle + 1)))


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of ``doc_id`` and sorted, the first row of the next range lent at the end.

    One shuffle moves the texts; the ranges' first rows are found on ids and digests.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_place(F.col("doc_id"), sorted(set(cuts))))
    rows = rows.select("doc_id", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), part.alias("part"))
    heads = sorted(rows.groupBy("part").agg(F.max(F.struct("doc_id", "digest")).alias("h")).collect())  # one of each range
    lent = [(h["h"]["doc_id"], h["h"]["digest"], heads[(k + 1) % len(heads)]["part"]) for k, h in enumerate(heads)]
    lent = spark.createDataFrame(lent, "head_id bigint, head_digest string, lent_to int")
    joined = rows.join(F.broadcast(lent), rows.doc_id.eqNullSafe(lent.head_id) & (rows.digest == lent.head_digest), "left")
    places = F.array_compact(F.array(F.struct("part", F.lit(False).alias("lent")),
                                     F.when(F.col("lent_to").isNotNull(), F.struct(F.col("lent_to").alias("part"), F.lit(True).alias("lent")))))
    dealt = joined.select("doc_id", "text", "digest", F.explode(places).alias("p")).select("doc_id", "text", "digest", "p.part", "p.lent")
    dealt = dealt.repartitionById(max(parts, len(cuts) + 1), F.col("part").cast("int"))
    return dealt.sortWithinPartitions("lent", F.col("doc_id").desc_nulls_last(), F.col("digest").desc()), parts


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, with both likenesses."""
    ranks = rarity(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """All rows but the last, which only follows."""
        own, changed = [t for _, t in rows], [edited(t, u) for (_, t), (_, u) in zip(rows, rows[1:])]
        raw = [t.encode() for t in changed]
        chains, others = digests([t.encode() for t in own], ranks), digests(raw, ranks)
        return pa.record_batch(
            [pa.array([d for d, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in own[:-1]], pa.int64()),
             pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([as_text(c) for c in chains[:-1]]),
             pa.array([as_text(c) for c in others]), pa.array([likeness(a, b) for a, b in zip(chains, others)]),
             pa.array([likeness(a, b) for a, b in zip(chains, chains[1:])])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, False
        for batch, texts in slices(batches):
            for doc_id, text, lent in zip(batch.column("doc_id").to_pylist(), texts, batch.column("lent").to_pylist()):
                if done:
                    continue
                held.append((doc_id, text))
                size += len(text)
                done = lent  # a first row that is lent twice follows once
                if len(held) > 1 and (size > SLICE_BYTES // 4 or done):
                    yield emit(held)
                    held, size = held[-1:], len(held[-1][1])

    rows, _ = with_next(docs)
    return rows.select("doc_id", "text", "lent").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
