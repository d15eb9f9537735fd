"""Measured decisions: what may be broadcast and which groups are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_BROADCAST_ROWS = 1_000_000
#: Blocks that a group is cut into at most, as long as they hold no more than this many rows.
MOST_BLOCKS, ROWS_HELD = 6, 20_000


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(field.dataType, T.ArrayType):
        size = F.size(c) * 8
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("bigint") + 16


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and approximate bytes, from one partially aggregated pass."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def is_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    rows, size = measure(df)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint when the measured size allows it, else ``df`` unchanged."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def block_counts(df: DataFrame, keys: list[str], rows_per_block: int, name: str) -> DataFrame:
    """Keys with more rows than one block holds, and how many blocks each needs.

    A row is sent to a task for each block that it meets, so small blocks of a large group
    would copy the table hundreds of times. Beyond ``MOST_BLOCKS`` blocks grow with
    the group instead, up to ``ROWS_HELD`` rows; only then are there more of them.
    At most ``rows / rows_per_block`` keys can qualify, so the result stays small
    however many keys there are; it is broadcast if measuring confirms that.
    """
    most = F.greatest(F.lit(MOST_BLOCKS), F.ceil(F.col("_n") / ROWS_HELD))
    return broadcast_if_small(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                              .where(F.col("_n") > rows_per_block)
                              .select(*keys, F.least(F.ceil(F.col("_n") / rows_per_block), most).cast("int").alias(name)))


def spread(df: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the block count of each row's group; 1 for a group that fits one block."""
    return (df.join(counts, keys, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(1))))


def block_of(id_col: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.col(blocks).cast("bigint")).cast("int")
