"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 r`` bits have a common variant within ``r``
bits of both. So every distinct fingerprint emits all its variants within half the
radius, and fingerprints that share a variant are linked; fingerprints of one variant
are pairwise within the radius, so a star for each variant keeps every link.

The variants are shuffled by their leading bits. Variants of one fingerprint that agree
in these travel as one row and are unfolded where they arrive, which moves dozens of rows
for a fingerprint instead of thousands. The number of leading bits follows the number of
fingerprints, so that what a group unfolds stays near ``CELL_VARIANTS``; a larger group is
unfolded by its next bits, part after part.

A null or wordless text has fingerprint zero, which links like any other. Equal
fingerprints fold into one before anything is compared. Null ids count as larger than all
others; a group of null ids only has a null component. Repeated rows, ties and extra
columns are allowed, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factstore.llm.common import fresh_name, saved, slices

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Variants that a group unfolds at a time.
CELL_VARIANTS = 1_000_000
_SHINGLES_AT_ONCE = 100_000


def fingerprint(text: str) -> int:
    """Bits set in over half of the shingles' XXH64, as a signed 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()][:max(1, len(words) - SHINGLE + 1)]
    ends = (ends - 1).tolist()[min(SHINGLE, len(words)) - 1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        pairs = zip(starts[at:at + _SHINGLES_AT_ONCE], ends[at:at + _SHINGLES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with its fingerprint in a column ``name``."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.record_batch([*batch.select(columns).columns, found], [*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, LongType())]))


def _around(size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of ``size`` bits with up to ``reach`` (at most 2) bits set, and how many are set."""
    one = np.uint64(1) << np.arange(size, dtype=np.uint64)
    masks, far = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
    if reach >= 1:
        masks.append(one)
        far.append(np.full(size, 1))
    if reach >= 2:
        a, b = np.triu_indices(size, 1)
        masks.append(one[a] | one[b])
        far.append(np.full(len(a), 2))
    return np.concatenate(masks), np.concatenate(far)


def _unfold(rest: np.ndarray, reach: np.ndarray, size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among members whose variants of ``size`` bits meet: pairs of places in ``rest``.

    ``reach`` says how many of the remaining bits each member may still change.
    """
    if len(rest) < 2:
        return
    counts = {r: int((reach == r).sum()) for r in range(RADIUS // 2 + 1)}
    total = sum(n * len(_around(size, r)[0]) for r, n in counts.items() if n)
    if total > most and size > 4:
        low = size - 4
        top, below = (rest >> np.uint64(low)).astype(np.int64), rest & np.uint64((1 << low) - 1)
        masks, far = _around(4, RADIUS // 2)
        distance = np.full(16, 99)
        distance[masks.astype(np.int64)] = far
        for part in range(16):
            left = reach - distance[top ^ part]
            here = np.flatnonzero(left >= 0)
            for a, b in _unfold(below[here], left[here], low, most):
                yield here[a], here[b]
        return
    variants, owners = [], []
    for r, n in counts.items():
        if n:
            own = np.flatnonzero(reach == r)
            masks, _ = _around(size, r)
            variants.append((rest[own, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own, len(masks)))
    variant = np.concatenate(variants)
    owner = np.concatenate(owners).astype(np.int32)
    del variants, owners
    ordered = np.sort(variant)
    shared = ordered[1:][ordered[1:] == ordered[:-1]].copy()
    del ordered
    if not len(shared):
        return
    # A small table of hashes leaves few candidates for the exact look-up.
    place = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    seen = np.zeros(1 << 20, bool)
    seen[place(shared)] = True
    keep = np.flatnonzero(seen[place(variant)])
    keep = keep[np.isin(variant[keep], shared)]
    keep = keep[np.argsort(variant[keep], kind="stable")]
    variant, owner = variant[keep], owner[keep]
    first = np.maximum.accumulate(np.where(np.r_[True, variant[1:] != variant[:-1]], np.arange(len(variant)), 0))
    a, b = owner[first], owner
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    yield pairs[:, 0], pairs[:, 1]


def _forest(prints: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links folded to one for each member: (member, smallest member it reaches here)."""
    label = np.arange(len(prints))
    for a, b in links:
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        a, b = a[near], b[near]
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, before, label)
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def links(prints: DataFrame, cell_variants: int = CELL_VARIANTS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` within the radius."""
    spark, count = prints.sparkSession, prints.count()
    ball = len(_around(BITS, RADIUS // 2)[0])
    lead = min(24, max(4, int(np.ceil(np.log2(max(1, count) * ball / cell_variants + 1)))))
    masks, far = _around(lead, RADIUS // 2)
    masks, rest_bits = masks.astype(np.int64), BITS - lead

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                fp = batch.column("fp").slice(at, 4000).to_numpy(zero_copy_only=False)
                top = (fp.view(np.uint64) >> np.uint64(rest_bits)).astype(np.int64)
                cell = (top[:, None] ^ masks[None, :]).ravel()
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(np.repeat(fp, len(masks)))], ["cell", "fp"])

    def meet(group: pa.Table) -> pa.Table:
        fp = np.sort(group.column("fp").to_numpy()).astype(np.int64).view(np.uint64)
        cell = int(group.column("cell")[0].as_py())
        away = np.bitwise_count((fp >> np.uint64(rest_bits)) ^ np.uint64(cell)).astype(np.int64)
        found = _unfold(fp & np.uint64((1 << rest_bits) - 1), RADIUS // 2 - away, rest_bits, cell_variants)
        a, b = _forest(fp, found, RADIUS)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    cells = prints.select("fp").mapInArrow(emit, "cell int, fp bigint")
    return cells.groupBy("cell").applyInArrow(meet, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` of every node with an edge ``a, b``; ``root`` is the smallest node it reaches.

    Each round hangs every node's larger neighbours to its smallest one, then its smaller
    neighbours; stars remain. The edges of each round are written to the shared folder.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "links")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = saved(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError("the components did not settle")


def _roots(prints: DataFrame) -> DataFrame:
    """``fp, root`` for each distinct fingerprint of ``prints`` (saved rows with ``fp``)."""
    distinct = saved(prints.select("fp").distinct(), "fingerprints")
    found = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = saved(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "simhash")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = saved(_roots(prints).join(firsts, "fp"), "roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest id.

    Among equal ids the smallest fingerprint stays, and one row of those that are left.
    """
    name, row, kept_id, kept_fp = (fresh_name(docs.columns, c) for c in ("fp", "place", "kept_id", "kept_fp"))
    printed = with_fingerprint(docs, name)
    prints = saved(printed.select("doc_id", F.col(name).alias("fp")).distinct(), "simhash")
    order = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "fp")
    kept = (prints.join(_roots(prints), "fp").withColumn("place", F.row_number().over(order)).where("place = 1")
            .select(F.col("doc_id").alias(kept_id), F.col("fp").alias(kept_fp)))
    joined = printed.join(kept, F.col(name).eqNullSafe(F.col(kept_fp)) & F.col("doc_id").eqNullSafe(F.col(kept_id)))
    twins = Window.partitionBy(kept_fp, kept_id).orderBy(F.lit(0))
    return joined.withColumn(row, F.row_number().over(twins)).where(F.col(row) == 1).select(*docs.columns)
