"""Record tables on disk: append, scan, snapshots and exports.

A table is spread over a fixed number of directories by a hash of the namespace and
sorted by namespace inside its files. One directory per namespace would not survive
millions of them; this way a scan of one namespace opens one directory and skips the
row groups of the others.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from factstore.functions.dates import parse_created_at, utc_now_text
from factstore.functions.text import csv_line, metadata_cell, quoted_csv_line, record_id
from factstore.operators.records import export_records, list_namespace, lookup, of_entity
from factstore.operators.sizing import broadcast_if_small
from factstore.operators.validate import check_export_format
from factstore.schema import EXPORT_COLUMNS, LIST_LIMIT
from factstore.sources.files import children, create_exclusively, exists, read_text

BUCKETS = 64
#: Records of a range of a stored listing.
ROWS_PER_RANGE = 50_000
#: Records that a task puts in order, and tasks of a listing at most: the driver samples for each task and lists its directory.
ROWS_PER_TASK, MOST_TASKS = 5_000, 1_000
#: How long a version that another job has begun is waited for.
CLAIM_SECONDS = 60.0
_BUCKET_COLUMN = "namespace_of_{}"
_VERSION = re.compile(r"^version=(\d+)$")


def _bucket(user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(user_id, F.lit(""))), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, mode: str, buckets: int) -> None:
    column = _BUCKET_COLUMN.format(buckets)
    # Rows lie by namespace and id, and each row group tells which ids it may hold.
    order = ["user_id", *(c for c in ("id",) if c in df.columns)]
    writer = df.withColumn(column, _bucket(F.col("user_id"), buckets))
    # Rebalancing merges small partitions and splits the one a large namespace makes.
    writer = writer.hint("rebalance", column).sortWithinPartitions(column, *order).write.mode(mode).partitionBy(column)
    for name in order[1:]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
            f"parquet.bloom.filter.adaptive.enabled#{name}", "true")
    writer.parquet(path)


def new_records(rows: DataFrame, batch: str, keys: list[str], created_at: str | None = None) -> DataFrame:
    """Give rows an id made from ``batch`` and ``keys``, and a creation time."""
    when = F.lit(created_at) if created_at is not None else utc_now_text()
    with_id = rows if "id" in rows.columns else rows.withColumn("id", record_id(F.lit(batch), *keys))
    return with_id.withColumn("created_at", when)


def append(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append records that already carry ids and creation times."""
    _write(df, path, "append", buckets)


def scan(spark: SparkSession, path: str, user_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Read a record table; with ``user_id`` only its directory is opened."""
    df = spark.read.parquet(path)
    marks = [c for c in df.columns if c.startswith("namespace_of_")]
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
        for mark in marks:
            df = df.where(F.col(mark) == _bucket(F.lit(user_id), int(mark.rsplit("_", 1)[1])))
    df = df.drop(*marks)
    return df if limit is None else df.limit(limit)


def _version_file(root: str, version: int) -> str:
    return f"{root}/version={version}/paths.json"


def find(spark: SparkSession, path: str, ids: DataFrame, column: str = "memory_id") -> DataFrame:
    """Requested ids with their stored records; a few ids open few row groups."""
    return lookup(scan(spark, path), ids, column)


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    """Completely written versions, oldest first."""
    names = [(_VERSION.match(n), n) for n in children(spark, root)]
    return sorted(int(m.group(1)) for m, n in names if m and exists(spark, f"{root}/{n}/paths.json"))


def _claim(spark: SparkSession, root: str, version: int, content: dict) -> bool:
    """Make ``version`` the given one, unless another job has taken its number."""
    place = f"{root}/version={version}"
    return not exists(spark, place) and create_exclusively(spark, f"{place}/paths.json", json.dumps(content))


def _snapshot(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(read_text(spark, _version_file(root, version)))


def _store_part(df: DataFrame, root: str, buckets: int) -> dict[str, list[str]]:
    """Write rows below ``data``; the directory of each bucket that has some, relative to the root."""
    spark, part = df.sparkSession, f"data/{uuid.uuid4().hex}"
    _write(df, f"{root}/{part}", "errorifexists", buckets)
    prefix = _BUCKET_COLUMN.format(buckets) + "="
    return {n[len(prefix):]: [f"{part}/{n}"] for n in children(spark, f"{root}/{part}") if n.startswith(prefix)}


def write_snapshot(df: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Write a whole table as the next version and return its number.

    Rows lie below ``data``, a directory for each bucket; a version is a file that names the
    directories, created last and by one job alone. So the version being read is never
    overwritten, a failed write leaves the table as it was, and a number that another job has
    taken is left to it and the next one is tried.
    """
    spark = df.sparkSession
    content = {"buckets": buckets, "schema": df.schema.json(), "paths": _store_part(df, root, buckets)}
    taken = [int(m.group(1)) for m in map(_VERSION.match, children(spark, root)) if m]
    version = max(taken, default=0) + 1
    while not _claim(spark, root, version, content):
        version += 1
    return version


def _paths(spark: SparkSession, root: str, content: dict, chosen: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    paths = [f"{root}/{p}" for k, own in content["paths"].items() if chosen is None or k in chosen for p in own]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, user_id: str | None = None) -> DataFrame:
    """A version of the table, the newest one by default; with ``user_id`` only its bucket is opened."""
    done = snapshot_versions(spark, root)
    if not done:
        raise ValueError(f"no snapshot below '{root}'")
    content = _snapshot(spark, root, version or done[-1])
    if user_id is None:
        return _paths(spark, root, content)
    own = spark.range(1).select(_bucket(F.lit(user_id), content["buckets"]).alias("b")).first()["b"]
    return _paths(spark, root, content, [str(own)]).where(F.col("user_id") == user_id)


def change_snapshot(spark: SparkSession, root: str, changed: Callable[[DataFrame], DataFrame],
                    change: Callable[[DataFrame], DataFrame]) -> int:
    """The next version, in which only the buckets of the rows that change are written anew.

    ``changed`` gives, of the newest version, the rows that a change concerns (their ``user_id``
    counts); ``change`` gives rows as they are afterwards, of whole buckets. Where nothing
    changes the version stays. If another job makes a version meanwhile, the change is made again
    on that one, so none is lost. Rows may get another ``user_id``; their new bucket then holds
    files of both.
    """
    while True:
        version = snapshot_versions(spark, root)[-1]
        content = _snapshot(spark, root, version)
        buckets = content["buckets"]
        # At most one row for each bucket.
        rows = changed(_paths(spark, root, content)).select(_bucket(F.col("user_id"), buckets).alias("b")).distinct().collect()
        touched = sorted(str(r["b"]) for r in rows)
        if not touched:
            return version
        written = _store_part(change(_paths(spark, root, content, touched)), root, buckets)
        paths = {k: own for k, own in content["paths"].items() if k not in touched}
        for k, own in written.items():
            paths[k] = paths.get(k, []) + own
        number, since = version + 1, time.monotonic()
        while exists(spark, f"{root}/version={number}") and snapshot_versions(spark, root)[-1] == version:
            # Another job has the number. If it does not end, it is passed over.
            if time.monotonic() - since < CLAIM_SECONDS:
                time.sleep(0.2)
            else:
                number += 1
        if snapshot_versions(spark, root)[-1] == version and _claim(spark, root, number, {**content, "paths": paths}):
            if snapshot_versions(spark, root)[-1] == number:
                return number


def list_page(spark: SparkSession, path: str, user_id: str, limit: int | None = None) -> DataFrame:
    """A listing without vectors; with a limit the earliest records."""
    return list_namespace(scan(spark, path, user_id).drop("embedding"), user_id, limit)


def write_listing(df: DataFrame, path: str, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Records in the order of listings, cut into ranges, with a directory of their counts.

    A range holds neighbouring records of one namespace or several; the directory says how
    many of each namespace it holds, so that the range of any position follows from sums.
    Tasks get more records than a small range has, and cut what they have put in order into
    the ranges of one directory, each a row group of its own.
    """
    spark, order = df.sparkSession, ["user_id", "_epoch", "id"]
    rows = df.withColumn("_epoch", parse_created_at("created_at")).repartitionByRange(_listing_tasks(df.count(), rows_per_range), *order)
    # The number of a task, and below it that of the record in the task's order.
    place = rows.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    task, row = F.shiftright("_place", 33), F.expr("_place & 8589934591")
    (place.withColumn("range", F.shiftleft(task, 33) + F.floor(row / rows_per_range)).withColumn("part", _part_of("range")).drop("_place")
     .sortWithinPartitions("part", "range", *order).write.mode("errorifexists").partitionBy("part")
     .option("parquet.block.row.count.limit", rows_per_range).parquet(f"{path}/rows"))
    # Written from the files themselves; a listing without it is not finished.
    (spark.read.schema(_listed(df.schema)).parquet(f"{path}/rows").groupBy("user_id", "range").agg(F.count(F.lit(1)).alias("n"))
     .sort("user_id", "range").write.mode("errorifexists").parquet(f"{path}/ranges"))


def _listing_tasks(records: int, rows_per_range: int) -> int:
    return max(1, min(-(-records // max(rows_per_range, ROWS_PER_TASK)), MOST_TASKS))


def _part_of(range_name: str) -> Column:
    """The directory of a range."""
    return F.shiftright(range_name, 33).cast("int")


def _listed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("_epoch", T.DoubleType()), T.StructField("range", T.LongType()),
                         T.StructField("part", T.IntegerType())])


def listing_page(spark: SparkSession, path: str, user_id: str | None = None, limit: int = LIST_LIMIT, page: int = 1) -> DataFrame:
    """A page of one namespace, or of each, with its ``position``: only the ranges that it lies in are read.

    The records before them are counted in the directory and never sorted.
    """
    if limit < 1 or page < 1:
        raise ValueError("limit and page start at 1")
    first = (page - 1) * limit
    before = Window.partitionBy("user_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spark.read.parquet(f"{path}/ranges").select("user_id", "range", "n")
    ranges = ranges if user_id is None else ranges.where(F.col("user_id") == user_id)
    met = (ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
           .where((F.col("before") < first + limit) & (F.col("before") + F.col("n") > first)))
    # A page lies in a few ranges of a namespace; the first of them says where the count starts.
    met = met.select("user_id", "range", _part_of("range").alias("part"), F.min("before").over(Window.partitionBy("user_id")).alias("before"))
    if user_id is not None:
        held = met.collect()
        rows = spark.read.parquet(f"{path}/rows").where(
            F.col("range").isin(*[r["range"] for r in held]) & F.col("part").isin(*{r["part"] for r in held}) if held else F.lit(False))
        rows = rows.where(F.col("user_id") == user_id).withColumn("before", F.lit(held[0]["before"] if held else 0))
    else:
        rows = spark.read.parquet(f"{path}/rows").join(broadcast_if_small(met), ["user_id", "part", "range"])
    place = Window.partitionBy("user_id").orderBy(F.col("_epoch").asc_nulls_first(), F.col("id").asc_nulls_first())
    return (rows.withColumn("position", F.row_number().over(place) + F.col("before"))
            .where((F.col("position") > first) & (F.col("position") <= first + limit)).drop("_epoch", "range", "part", "before"))


def export_manifest(df: DataFrame) -> DataFrame:
    """Number of exported records per namespace."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("count"))


def csv_rows(records: DataFrame, style: str = "minimal") -> DataFrame:
    """The CSV lines of the export, header not included."""
    if style == "minimal":
        cells = ["id", "memory", metadata_cell("metadata"), "created_at", "user_id"]
        return records.select(csv_line(*cells).alias("value"))
    return records.select(quoted_csv_line(*EXPORT_COLUMNS).alias("value"))


def export(df: DataFrame, path: str, fmt: str = "json", user_id: str | None = None) -> DataFrame:
    """Write one namespace, or all with no ``user_id``; returns the manifest."""
    check_export_format(fmt)
    chosen = of_entity(df, user_id) if user_id else df
    records = export_records(chosen, user_id)
    if fmt == "json":
        export_json(records, path)
    else:
        export_csv(records, path)
    return export_manifest(records).withColumn("format", F.lit(fmt))


def export_json(records: DataFrame, path: str) -> None:
    """JSON Lines with metadata as an object, and a manifest beside them."""
    meta = F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}")))
    records.withColumn("metadata", meta).write.mode("errorifexists").json(f"{path}/memories")
    export_manifest(records).withColumn("format", F.lit("json")).write.mode("errorifexists").json(f"{path}/manifest")


def export_csv(records: DataFrame, path: str, style: str = "minimal") -> None:
    """CSV text. The first part file holds the header alone, so the part files put
    together in name order are the whole document, whatever their number."""
    spark = records.sparkSession
    header = spark.createDataFrame([(",".join(EXPORT_COLUMNS),)], "value string").coalesce(1)
    ending = "\r\n" if style == "minimal" else "\n"
    (header.union(csv_rows(records, style))
     .write.mode("errorifexists").option("lineSep", ending).text(path))
