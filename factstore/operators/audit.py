"""Vector dimension audit of collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factstore.functions.text import _col
from factstore.schema import EMBED_DIMS


class DimensionMismatch(ValueError):
    """A collection holds vectors of another size than the embedder's."""


def config_dims(config) -> Column:
    """Vector size from a collection's ``vectors`` setting.

    Either ``{"size": n}`` or ``{name: {"size": n}}``; null for any other shape.
    """
    vectors = F.try_parse_json(_col(config))
    members = F.try_variant_get(vectors, "$", "map<string,variant>")
    sizes = F.transform(F.map_values(members), lambda v: F.try_variant_get(v, "$.size", "int"))
    named = F.try_element_at(F.filter(sizes, lambda s: s.isNotNull()), F.lit(1))
    return F.coalesce(named, F.try_variant_get(vectors, "$.size", "int"))


def audit_dims(collections: dict[str, DataFrame], dims: int = EMBED_DIMS) -> DataFrame:
    """``(collection, dim, n_rows, status, action)`` for every size present.

    A collection without vectors gives no row.
    """
    def sizes(name: str, df: DataFrame) -> DataFrame:
        return (df.where(F.col("embedding").isNotNull())
                .groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.lit(name).alias("collection"), "dim", "n_rows"))

    found = reduce(DataFrame.unionByName, [sizes(n, d) for n, d in collections.items()])
    same = F.col("dim") == dims
    size = F.col("dim").cast("string")
    return found.withColumns({
        "status": F.when(same, "ok").otherwise("mismatch"),
        "action": F.when(same, F.concat(F.col("collection"), F.lit(" OK ("), size, F.lit(")")))
                   .otherwise(F.concat(F.col("collection"), F.lit(" mismatch (was "), size, F.lit(")")))})


def enforce_dims(collections: dict[str, DataFrame], dims: int = EMBED_DIMS,
                 policy: str = "strict") -> dict[str, DataFrame]:
    """Apply the audit: ``strict`` refuses on a mismatch, ``drop`` keeps the rows that conform."""
    if policy not in ("strict", "drop"):
        raise ValueError("policy must be 'strict' or 'drop'")
    if policy == "drop":
        return {n: d.where(F.size("embedding") == dims) for n, d in collections.items()}
    wrong = audit_dims(collections, dims).where(F.col("status") == "mismatch").agg(
        F.count_distinct("collection").alias("collections"), F.count(F.lit(1)).alias("sizes"),
        F.sum("n_rows").alias("rows"), F.min("collection").alias("first")).first()
    if wrong["sizes"]:
        raise DimensionMismatch(
            f"embedder needs {dims}: {wrong['rows']} rows of {wrong['sizes']} other sizes in {wrong['collections']} "
            f"collections, first '{wrong['first']}'; audit_dims lists them all")
    return collections
