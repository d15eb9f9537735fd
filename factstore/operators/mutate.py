"""Updates, deletes and pruning: each gives the table as it is afterwards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from factstore.functions.text import first_nonempty
from factstore.operators.records import below_retention, of_ids, older_than, preview
from factstore.operators.validate import accepted, rejects, validate_ids, validate_updates
from factstore.schema import DEFAULT_USER_ID, PRUNE_DAYS


def _unknown(requests: DataFrame, store: DataFrame, verb: str) -> DataFrame:
    """Requests for ids the store does not hold, as error rows.

    The store's ids are first reduced to the requested ones, so that few requests
    never make a large store shuffle.
    """
    held = of_ids(store.select("id"), requests.select(F.col("memory_id").cast("string").alias("id"))).withColumnRenamed("id", "memory_id")
    return (requests.join(held, "memory_id", "left_anti")
            .withColumns({
                "error_code": F.lit("unknown_id"),
                "message": F.concat(F.lit(f"Failed to {verb} memory '"), F.col("memory_id"), F.lit("'.")),
                "fix": F.lit(None).cast("string")}))


def update_memories(store: DataFrame, updates: DataFrame, encode=None) -> tuple[DataFrame, DataFrame]:
    """``(store, rejects)`` after replacing texts by id.

    Updates are ``(memory_id, content)`` with an optional ``pos``; the last one of an
    id wins. With ``encode`` (adds ``embedding`` from ``memory``) only the new texts
    are embedded; without it a changed record's vector is cleared, so that a search
    cannot answer from the old text.
    """
    checked = validate_updates(updates)
    valid = accepted(checked)
    order = F.col("pos") if "pos" in updates.columns else F.lit(0)
    latest = (valid.groupBy(F.col("memory_id").alias("id"))
              .agg(F.max_by("content", F.struct(order.alias("o"), F.col("content"))).alias("memory")))
    if encode is not None:
        latest = encode(latest)
    elif "embedding" in store.columns:
        latest = latest.withColumn("embedding", F.lit(None).cast(store.schema["embedding"].dataType))
    changed = latest.select("id", F.struct(*[c for c in latest.columns if c != "id"]).alias("_new"))
    joined = store.join(changed, "id", "left")
    replaced = [f.name for f in changed.schema["_new"].dataType.fields]
    result = joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced
        else F.col(c) for c in store.columns])
    failed = rejects(checked).unionByName(_unknown(valid, store, "update"), allowMissingColumns=True)
    return result, failed


def delete_memories(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(store, rejects)`` after deleting by ``memory_id``."""
    checked = validate_ids(ids)
    valid = accepted(checked)
    gone = valid.select(F.col("memory_id").alias("id")).distinct()
    failed = rejects(checked).unionByName(_unknown(valid, store, "delete"), allowMissingColumns=True)
    return store.join(gone, "id", "left_anti"), failed


def anti_by(store: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` value is not among the keys, for many ids or namespaces at once."""
    return store.join(keys.select(on).distinct(), on, "left_anti")


def delete_namespace(store: DataFrame, user_id: str = DEFAULT_USER_ID) -> DataFrame:
    return store.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def delete_entity(store: DataFrame, user_id: str | None) -> DataFrame:
    """As ``delete_namespace``, but the namespace must be given."""
    if not user_id:
        raise ValueError("user_id is required.")
    return delete_namespace(store, user_id)


class Prune(NamedTuple):
    store: DataFrame
    candidates: DataFrame
    report: DataFrame


def prune(store: DataFrame, as_of: float, days: float = PRUNE_DAYS, dry_run: bool = True,
          min_score: float | None = None, user_id: str | None = None) -> Prune:
    """Remove records older than ``days`` before ``as_of`` (epoch seconds).

    The rule reads only the record itself, so what remains is a filter on the scan.
    A matching record without an id is reported but stays, as it cannot be deleted.
    """
    old = older_than(days, as_of) & (below_retention(min_score) if "score" in store.columns or min_score is None
                                     else F.lit(False))
    if user_id is not None:
        old = old & F.col("user_id").eqNullSafe(F.lit(user_id))
    # Older rows carry their id as memory_id.
    names = [c for c in ("id", "memory_id") if c in store.columns]
    record = F.coalesce(first_nonempty(*names), F.lit(""))
    has_id = record != ""
    candidates = store.where(old).select(
        record.alias("id"), preview().alias("memory"), "created_at")
    report = candidates.agg(
        F.count(F.lit(1)).alias("would_delete"),
        (F.lit(0).cast("bigint") if dry_run else F.count_if(F.col("id") != "")).alias("deleted"),
    ).withColumn("dry_run", F.lit(dry_run))
    remaining = store if dry_run else store.where(~(old & has_id))
    return Prune(remaining, candidates, report)
