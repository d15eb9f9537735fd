"""Sharding as vector bin packing: bytes, tokens and rows are balanced together.

Equal texts are one group. Each group goes to the shard where the dot product of its size
vector with the residual capacity is highest, the largest groups first.

* A group of more than half a shard's bytes cannot stay whole in shards of near equal bytes; it
  is split by row into parts of at most half a shard in any measure. There are at most two for a shard. A
  group of many rows or tokens that are few bytes stays whole, as the law does not need more.
* Groups above ``HEAVY`` of a shard, whose number that share bounds, are placed together.
* All others are dealt by hash into blocks of about ``BLOCK_GROUPS`` groups. Each block
  fills its part of the capacity that is left, so blocks are placed side by side.

Slots are numbered inside hashed pieces of each shard and shifted by the sizes of the
pieces before, so that no shard is sorted in one task.

A null or empty text has size 8 (the row itself) and no tokens, and all of them are one
group. Repeated rows are rows of their own, null ids are kept, extra columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from factstore.llm.common import saved, text_slices, worker_state
from factstore.llm.token_counts import counter, merges_by_id, tokenizer_digest

HEAVY = 1 / 500
BLOCK_GROUPS = 50_000
PIECE_ROWS = 50_000
ROW_BYTES = 8
_MEASURES = ("size", "tokens", "n")
#: What bytes, tokens and rows weigh in the dot product; the law ``bytes`` puts bytes first.
WEIGHTS = (1.0, 0.1, 0.1)


def sized(docs: DataFrame, tokenizer: tuple[str, bytes]) -> DataFrame:
    """``row, doc_id, digest, size, tokens, text_crc32`` of every row; ``row`` tells rows apart."""
    name, ranked = tokenizer_digest(tokenizer), merges_by_id(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_state(f"counter-{name}", lambda: counter(tokenizer, ranked))
        at = TaskContext.get().partitionId() << 40
        for batch, texts in text_slices(batches):
            raw = [t.encode() for t in texts.to_pylist()]
            yield pa.record_batch(
                [pa.array(range(at, at + len(raw)), pa.int64()), batch.column("doc_id"),
                 pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                 pa.array([len(r) + ROW_BYTES for r in raw], pa.int64()), pa.array(count(texts), pa.int64()),
                 pa.array(map(zlib.crc32, raw), pa.int64())],
                ["row", "doc_id", "digest", "size", "tokens", "text_crc32"])
            at += len(raw)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"row bigint, doc_id {kind}, digest string, size bigint, tokens bigint, text_crc32 bigint")


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector, by the highest dot product with what is left; ``residual`` is used up.

    Both are shares of a shard's capacity. Ties go to the shard with the smaller number.
    """
    order = np.argsort(-vectors.max(1), kind="stable")
    weights = np.array(WEIGHTS)
    shards = np.empty(len(vectors), np.int32)
    for i in order.tolist():
        x = vectors[i]
        best = int((residual @ (x * weights)).argmax())
        shards[i] = best
        residual[best] -= x
    return shards


def pack(docs: DataFrame, shards: int, tokenizer: tuple[str, bytes]) -> DataFrame:
    """``row, doc_id, size, text_crc32, shard, slot`` of every row."""
    spark = docs.sparkSession
    rows = saved(sized(docs, tokenizer), "sized")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    capacity = [max(1.0, (t or 0) / shards) for t in total]

    share = F.greatest(*(F.col(m) / c for m, c in zip(_MEASURES, capacity)))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    # The shares in bytes add up to the number of shards, so at most 2 * shards groups are split.
    in_bytes = F.col("size") / capacity[0]
    large = rows.groupBy("digest").agg(*sums).where(in_bytes > 0.5).select("digest", F.ceil(share * 2).alias("parts")).collect()
    parts = F.broadcast(spark.createDataFrame(large, "digest string, parts bigint"))
    rows = (rows.join(parts, "digest", "left")
            .withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).drop("parts"))
    groups = saved(rows.groupBy("digest", "part").agg(*sums).withColumn("share", share), "groups")

    def vectors(held: pa.Table) -> np.ndarray:
        return np.stack([held.column(m).to_numpy() / c for m, c in zip(_MEASURES, capacity)], 1)

    def placed(held: pa.Table, residual: np.ndarray) -> pa.Table:
        held = held.sort_by([("digest", "ascending"), ("part", "ascending")])
        return pa.table({"digest": held.column("digest"), "part": held.column("part"),
                         "shard": pa.array(place(vectors(held), residual))})

    kind = "digest string, part bigint, shard int"
    heavy_rows = groups.where(F.col("share") > HEAVY)
    heavy = saved(heavy_rows.withColumn("block", F.lit(0) + F.col("part") * 0).groupBy("block").applyInArrow(lambda g: placed(g, np.ones((shards, 3))), kind), "heavy")
    left = np.ones((shards, 3))
    used = heavy.join(groups, ["digest", "part"]).groupBy("shard").agg(*(F.sum(m) for m in _MEASURES))
    for shard, *taken in used.collect():
        left[shard] -= np.array(taken) / capacity
    left = np.maximum(left, 0) + 1e-12

    light = groups.where(F.col("share") <= HEAVY)
    blocks = max(1, math.ceil(light.count() / BLOCK_GROUPS))

    def fill(held: pa.Table) -> pa.Table:
        # The block's part of what each shard has left; the block's own sum is the whole of it.
        return placed(held, left * (vectors(held).sum(0) / left.sum(0)))

    spread = (light.withColumn("block", F.pmod(F.xxhash64("digest", "part"), F.lit(blocks)))
              .groupBy("block").applyInArrow(fill, kind))
    where = heavy.unionByName(spread)
    found = rows.join(where, ["digest", "part"]).select("row", "doc_id", "size", "text_crc32", "shard")
    return _with_slots(found, total[2])


def _with_slots(rows: DataFrame, count: int) -> DataFrame:
    """Number the rows of each shard from 0 without a gap."""
    pieces = max(1, math.ceil(count / PIECE_ROWS))
    rows = saved(rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces))), "placed")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
             .select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "row")
    return (rows.withColumn("place", F.row_number().over(inside) - 1).join(first, ["shard", "piece"])
            .select("row", "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("bigint").alias("slot")))


def report(docs: DataFrame, shards: int, tokenizer: tuple[str, bytes]) -> DataFrame:
    """The assignment under the law ``bytes``."""
    return pack(docs, shards, tokenizer).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
