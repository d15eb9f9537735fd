"""Hadoop file system helpers, so that any storage Spark can reach works."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def hidden_files(root: str, ending: str) -> list[str]:
    """Paths below ``root`` that Spark's file sources leave out: a part of them starts with a dot or an underscore."""
    store, base = fs.FileSystem.from_uri(root)
    names = (i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File)
    return [n for n in names if n.endswith(ending) and any(p[:1] in "._" for p in n[len(base):].strip("/").split("/"))]


def read_bytes(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """``path, length, content`` of files, read where the tasks run."""
    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path) as file:
                    content = file.read()
                yield pa.record_batch([pa.array([path]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())],
                                      ["path", "length", "content"])

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200)))
    return names.mapInArrow(get, "path string, length bigint, content binary")


def qualified(spark: SparkSession, path: str) -> str:
    store, where = _fs(spark, path)
    return store.makeQualified(where).toString()


def is_directory(spark: SparkSession, path: str) -> bool:
    store, where = _fs(spark, path)
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a directory; empty when it does not exist."""
    store, where = _fs(spark, path)
    if not store.exists(where):
        return []
    return sorted(status.getPath().getName() for status in store.listStatus(where))


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _fs(spark, path)
    return store.exists(where)


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its content at once; false if there is one already.

    The content is written aside and then linked to its place by a rename that does not
    replace, so no reader meets half of it and of two writers one succeeds.
    """
    jvm = spark._jvm
    store, where = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store.mkdirs(where.getParent())
    out = store.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # The claim: a marker that only one writer can create.
    try:
        store.create(jvm.org.apache.hadoop.fs.Path(f"{path}.claim"), False).close()
    except Py4JJavaError as error:
        if "already exists" not in str(error.java_exception):
            raise
        store.delete(aside, False)
        return False
    return bool(store.rename(aside, where))


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _fs(spark, path)
    file = store.open(where)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(file)).decode()
    finally:
        file.close()


def write_files(df: DataFrame, root: str) -> None:
    """Write each row ``(file, text)`` as a file of its own below ``root``; a name given twice keeps one of the texts."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                place = f"{base}/{name}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                # A task that is run again replaces what it wrote.
                part = f"{place}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write((text or "").encode())
                store.move(part, place)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    df.select("file", "text").mapInArrow(put, "n bigint").write.format("noop").mode("overwrite").save()


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table so that every core has a share of it.

    A table of very few files would leave most cores idle in a stage that does much
    work per row. It is spread out only while it has fewer splits than there are
    cores, that is while it is small; a large table is read as it lies.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
