"""Markdown files as a table of documents."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from factstore.functions.text import relative_path, universal_newlines
from factstore.sources.files import hidden_files, is_directory, qualified, read_bytes

# Directories whose files are not documents.
SKIPPED_DIRECTORIES = ("node_modules", ".git", "vendor", "__pycache__", ".venv", "dist", "build")


def read_markdown(spark: SparkSession, directory: str) -> DataFrame:
    """``(file, n_bytes, text)`` of every ``*.md`` below a directory.

    Bytes that are not UTF-8 become replacement characters. Names starting with a
    dot or an underscore, which Spark's file sources leave out, are listed apart.
    """
    if not is_directory(spark, directory):
        raise ValueError(f"'{directory}' is not a directory")
    root = qualified(spark, directory)
    files = (spark.read.format("binaryFile")
             .option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "content"))
    hidden = hidden_files(root, ".md")
    if hidden:
        base = FileSystem.from_uri(root)[1]
        start = F.lit(root.rstrip("/"))
        apart = read_bytes(spark, root, hidden).withColumn("path", F.concat(start, F.substr("path", F.lit(len(base.rstrip("/")) + 1))))
        files = files.unionByName(apart)
    parts = F.split("file", "/")
    skipped = F.array(*[F.lit(name) for name in SKIPPED_DIRECTORIES])
    return (files.withColumn("file", relative_path("path", root))
            .where(~F.arrays_overlap(parts, skipped))
            .select("file", F.col("length").alias("n_bytes"),
                    universal_newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text")))


def in_path_order(files: DataFrame) -> DataFrame:
    """Sorted path part by path part, as a directory walk lists them."""
    return files.orderBy(F.split("file", "/"))
