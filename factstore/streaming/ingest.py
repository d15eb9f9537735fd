"""Structured Streaming forms of the add and import operations.

Every micro-batch writes to a directory named after its number and overwrites it, so
a batch that is run again after a failure replaces its own output. What an import has
seen is kept by a state store.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from factstore.functions.text import strict_json
from factstore.operators.chunks import add_facts, add_verbatim
from factstore.operators.dedup import first_of_batch, imported_rows, store_keys
from factstore.schema import ADD_REQUEST, CHUNK_CHARS, DEFAULT_USER_ID
from factstore.sources.files import children, exists
from factstore.sources.imports import parse_items
from factstore.sources.tables import new_records


def read_requests(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Add requests arriving as JSON Lines files."""
    return spark.readStream.schema(ADD_REQUEST).option("maxFilesPerTrigger", max_files).json(path)


def ingest_stream(requests: DataFrame, target: str, checkpoint: str, mode: str = "verbatim",
                  default_user: str = DEFAULT_USER_ID, max_chars: int = CHUNK_CHARS,
                  created_at: str | None = None) -> DataStreamWriter:
    """Validate, chunk and store a stream of add requests.

    Records go to ``target/records``, failed requests to ``target/rejects``. Ids come
    from namespace, ``request_id`` and chunk number.
    """
    add = add_verbatim if mode == "verbatim" else add_facts

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows, failed = add(batch, default_user, max_chars)
            keys = ["user_id", "request_id", "pos"] if mode == "verbatim" else ["user_id", "request_id"]
            stored = new_records(rows, mode, keys, created_at)
            stored.write.mode("overwrite").parquet(f"{target}/records/{_BATCH}{batch_id}")
            failed.write.mode("overwrite").parquet(f"{target}/rejects/{_BATCH}{batch_id}")
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


_BATCH, _BASE = "batch_id=", -1
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Seen:
    """The digests ever met, as the state of a stream over the batches' digests.

    A batch adds its digests below ``keys/batch_id=<n>`` and runs the stream on what is
    there anew: its state, in RocksDB, lets the unseen ones through to ``fresh``. No batch
    reads what an earlier one wrote, whatever their number, and the digests of an existing
    store go in once, as a batch before the first.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    def _place(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/{_BATCH}{batch_id}"

    def begin(self, base_keys: str | None) -> None:
        place = self._place("keys", _BASE)
        if base_keys and not exists(self.spark, f"{place}/_SUCCESS"):
            self.spark.read.schema("digest binary").parquet(base_keys).write.mode("overwrite").parquet(place)
            self._run()

    def fresh(self, digests: DataFrame, batch_id: int) -> DataFrame:
        """Those of the batch's digests that no earlier batch had; the same again for a batch that is run again."""
        place = self._place("keys", batch_id)
        if children(self.spark, place):
            # A batch that did not end: what it has added already stands.
            digests = digests.join(self.spark.read.schema("digest binary").parquet(place), "digest", "left_anti")
        digests.write.mode("append").parquet(place)
        self._run()
        found = self.spark.read.schema(f"digest binary, {_BATCH[:-1]} bigint").parquet(f"{self.folder}/fresh")
        return found.where(F.col(_BATCH[:-1]) == batch_id).select("digest")

    def _run(self) -> None:
        digests = self.spark.readStream.schema(f"digest binary, {_BATCH[:-1]} bigint").parquet(f"{self.folder}/keys")
        unseen = digests.dropDuplicates(["digest"]).where(F.col(_BATCH[:-1]) > _BASE)
        query = (unseen.writeStream.format("parquet").partitionBy(_BATCH[:-1]).option("path", f"{self.folder}/fresh")
                 .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()


def write_base_keys(store: DataFrame, path: str) -> None:
    """Key table of an existing store, written once before a stream starts."""
    store_keys(store).write.mode("overwrite").parquet(path)


def import_stream(items: DataFrame, target: str, checkpoint: str, base_keys: str | None = None,
                  default_user: str = DEFAULT_USER_ID, created_at: str | None = None) -> DataStreamWriter:
    """Duplicate-skipping import of a stream of ``(user_id, pos, data)`` items.

    ``data`` is one JSON item. A text counts as a duplicate of anything stored before
    it, however long ago; within a micro-batch the smallest ``pos`` comes first. What was
    stored is the state of an inner stream beside the checkpoint, and is lost with it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = _Seen(batch.sparkSession, f"{checkpoint.rstrip('/')}-keys")
        seen.begin(base_keys)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            parsed = parse_items(batch.withColumn(
                "item", F.coalesce(strict_json("data"), F.parse_json(F.lit("null")))).drop("data"))
            first, failed = first_of_batch(parsed, default_user)
            fresh = seen.fresh(first.select("digest"), batch_id)
            place = f"{_BATCH}{batch_id}"
            stored = new_records(imported_rows(first.join(fresh, "digest", "left_semi"), "stream"), "stream", ["digest"], created_at)
            stored.write.mode("overwrite").parquet(f"{target}/records/{place}")
            failed.write.mode("overwrite").parquet(f"{target}/rejects/{place}")
        finally:
            batch.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
