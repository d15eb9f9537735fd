"""Duplicate-skipping import.

Two records are duplicates when namespace and dedup key are equal. The key is
carried as a 32-byte digest, and both the batch and the store are reduced to one
row per key inside each task before the shuffle, so a key that makes up a third of
all rows costs one row per task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from factstore.functions.text import is_blank, key_digest, record_id
from factstore.operators.sizing import is_small
from factstore.operators.validate import accepted, rejects, validate_import, with_namespace
from factstore.schema import DEFAULT_USER_ID


class Import(NamedTuple):
    new_rows: DataFrame
    rejects: DataFrame
    checked: DataFrame


def text_keys(store: DataFrame) -> DataFrame:
    """Digests of the namespaces and texts already stored, one per record."""
    return store.where(~is_blank("memory")).select(key_digest("user_id", "memory").alias("digest"))


def store_keys(store: DataFrame) -> DataFrame:
    """The distinct digests, to be kept beside a store that is often imported into."""
    return text_keys(store).distinct()


def first_per_key(items: DataFrame, keys: tuple[str, ...] = ("digest",), order: str = "pos") -> DataFrame:
    """The first row of each key in input order.

    The rank filter is applied by every task to its own rows ahead of the shuffle.
    """
    ranked = Window.partitionBy(*keys).orderBy(order)
    return items.withColumn("_nth", F.row_number().over(ranked)).where(F.col("_nth") == 1).drop("_nth")


def dedup_against(items: DataFrame, keys: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """Items whose key is not stored yet. Both sides are partitioned by the same key.

    ``few`` holds the batch's digests when the batch is expected to be far smaller
    than the store. If measuring confirms it they are sent to the scan of the stored
    keys, and only the keys they meet are shuffled.
    """
    if few is not None and is_small(few):
        keys = keys.join(F.broadcast(few.distinct()), "digest", "left_semi")
    return items.join(keys.distinct(), "digest", "left_anti")


def import_memories(items: DataFrame, store: DataFrame | None, default_user: str = DEFAULT_USER_ID,
                    batch: str = "import", keys: DataFrame | None = None, small_batch: bool = False) -> Import:
    """Import parsed items ``(user_id, pos, item_type, memory, text_type, metadata)``.

    Failures are decided before duplicates. The id, owner and time an item may carry
    are ignored: the target namespace and a new id are used. ``batch`` names this
    import; ids come from it and the digest, which is unique after the duplicates are gone,
    so the same batch run again yields the same ids wherever its rows lay.

    ``keys`` are digests kept beside the store, read in place of its texts.
    ``small_batch`` says the items are expected to be few beside the store.
    """
    checked = validate_import(with_namespace(items, default_user))
    known = keys if keys is not None else text_keys(store)
    valid = accepted(checked).withColumn("digest", key_digest("user_id", "memory"))
    new = dedup_against(first_per_key(valid), known, valid.select("digest") if small_batch else None)
    return Import(imported_rows(new, batch), rejects(checked), checked)


def first_of_batch(items: DataFrame, default_user: str = DEFAULT_USER_ID) -> tuple[DataFrame, DataFrame]:
    """The first valid item of each ``digest`` among parsed items, and the failed items."""
    checked = validate_import(with_namespace(items, default_user))
    valid = accepted(checked).withColumn("digest", key_digest("user_id", "memory"))
    return first_per_key(valid), rejects(checked)


def imported_rows(new: DataFrame, batch: str) -> DataFrame:
    """New items with the ids that they get in the import named ``batch``."""
    return new.select(
        record_id(F.lit(batch), F.hex("digest")).alias("id"), "memory", "user_id", "metadata", "pos", "digest")


def import_report(result: Import) -> DataFrame:
    """Per namespace: imported, skipped, failed and the error messages with counts.

    There are only a handful of different messages, so the error list stays short
    however many items fail; the failed items themselves are in ``rejects``.
    """
    per_message = result.checked.groupBy("user_id", "message").agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("message").isNotNull(), F.struct("message", "n"))
    totals = per_message.groupBy("user_id").agg(
        F.sum(F.when(F.col("message").isNull(), F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.when(F.col("message").isNotNull(), F.col("n")).otherwise(0)).alias("failed"),
        F.array_sort(F.collect_list(entry)).alias("_errors"))
    imported = result.new_rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("imported"))
    got = F.coalesce(F.col("imported"), F.lit(0)).cast("bigint")
    return totals.join(imported, "user_id", "left").select(
        "user_id", got.alias("imported"), (F.col("valid") - got).alias("skipped"),
        F.col("failed").cast("bigint").alias("failed"),
        F.when(F.size("_errors") > 0, F.col("_errors")).alias("errors"))


def import_status(result: Import) -> DataFrame:
    """Outcome of every item: imported, skipped or failed.

    Matching on the item's position, which is unique, keeps equal texts from piling
    up in one partition.
    """
    new = result.new_rows.select("user_id", "pos", F.lit(True).alias("_new"))
    return (result.checked.join(new, ["user_id", "pos"], "left")
            .withColumn("status", F.when(F.col("error_code").isNotNull(), "failed")
                        .when(F.col("_new"), "imported").otherwise("skipped"))
            .drop("_new"))


def union_store(store: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Existing and newly imported rows together; columns one side lacks are null."""
    shared = [c for c in new_rows.columns if c in store.columns]
    return store.unionByName(new_rows.select(*shared), allowMissingColumns=True)
