"""Verbatim and document ingest: requests or files in, chunk rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factstore.functions.chunking import chunk_text, header_import, header_server, tag_chunk
from factstore.functions.text import is_blank, py_strip, record_id
from factstore.operators.validate import accepted, rejects, skip_short, validate_add, with_namespace
from factstore.schema import CHUNK_CHARS, DEFAULT_USER_ID, MIN_DOCUMENT_CHARS


def explode_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per chunk with ``pos``, ``n_chunks`` and ``memory``.

    The count is taken ahead of the explode so that the array itself is not carried
    on every output row. The explode is an outer one because a plain one first filters
    by the array's size, and that filter would chunk every text a second time.
    """
    kept = [c for c in df.columns if c != chunks]
    return (df.withColumn("n_chunks", F.size(chunks))
            .select(*kept, "n_chunks", F.posexplode_outer(chunks).alias("pos", "memory"))
            .where(F.col("pos").isNotNull()))


def ingest_verbatim(df: DataFrame, max_chars: int = CHUNK_CHARS, compat: bool = True) -> DataFrame:
    """Valid add requests as chunk rows.

    Text within the limit is stored as it is. Longer text is packed below the limit
    under a context header and its chunks are tagged ``i/n``.
    """
    content = F.col("content")
    whole = F.length(content) <= max_chars
    chunks = F.when(whole, F.array(content)).otherwise(
        chunk_text(content, max_chars, header_server("metadata"), compat))
    rows = explode_chunks(df.withColumn("packed", ~whole).withColumn("chunks", chunks).drop("content"))
    # A text over the limit is tagged even where it packs into a single chunk.
    return rows.withColumn("metadata", tag_chunk("metadata", "pos", "n_chunks", F.col("packed"))).drop("packed")


def add_verbatim(requests: DataFrame, default_user: str = DEFAULT_USER_ID, max_chars: int = CHUNK_CHARS,
                 compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` for a table of verbatim add requests."""
    checked = validate_add(with_namespace(requests, default_user), "verbatim", max_chars)
    return ingest_verbatim(accepted(checked), max_chars, compat), rejects(checked)


def add_facts(requests: DataFrame, default_user: str = DEFAULT_USER_ID,
              max_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` for a table of single facts, stored unchanged."""
    checked = validate_add(with_namespace(requests, default_user), "fact", max_chars)
    return accepted(checked).withColumnRenamed("content", "memory"), rejects(checked)


def chunk_documents(docs: DataFrame, user_id, chunk_chars: int = CHUNK_CHARS, compat: bool = True) -> DataFrame:
    """Documents ``(file, text)`` as chunk rows with header, tag and metadata.

    ``user_id`` is a namespace name or a column of it.
    """
    owner = F.lit(user_id) if isinstance(user_id, str) else user_id
    kept = (skip_short(docs, MIN_DOCUMENT_CHARS)
            .select("file", "text", owner.alias("user_id"))
            .withColumn("metadata", F.to_json(F.struct(
                F.col("file"), F.col("user_id").alias("repo"), F.lit("docs_import").alias("source"))))
            .withColumn("chunks", chunk_text("text", chunk_chars, header_import("file"), compat))
            .drop("text"))
    # A header too long for the limit yields no chunks; the document shows as failed.
    rows = (kept.withColumn("n_chunks", F.coalesce(F.size("chunks"), F.lit(0)))
            .select("file", "user_id", "metadata", "n_chunks",
                    F.posexplode_outer("chunks").alias("pos", "memory")))
    return rows.withColumn("metadata", tag_chunk("metadata", "pos", "n_chunks"))


def import_documents(docs: DataFrame, user_id, chunk_chars: int = CHUNK_CHARS,
                     store_chars: int = CHUNK_CHARS, compat: bool = True) -> DataFrame:
    """Chunk rows as the store keeps them.

    When the importer's chunk size is above the store's, an importer chunk is packed
    a second time under the store's header and its tag is overwritten. ``part`` is
    the importer's chunk number, ``pos`` the position within it.
    """
    rows = (chunk_documents(docs, user_id, chunk_chars, compat)
            .where(F.col("memory").isNotNull())
            .withColumnRenamed("pos", "part"))
    if chunk_chars > store_chars:
        again = rows.drop("n_chunks").withColumnRenamed("memory", "content")
        stored = ingest_verbatim(again, store_chars, compat)
    else:
        stored = rows.withColumn("pos", F.lit(0))
    return stored.withColumn("id", record_id("user_id", "file", "part", "pos"))


def plan_import(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, compat: bool = True) -> DataFrame:
    """Dry run: bytes and chunks per file, counted without a header; nothing is written."""
    return docs.select("file", F.col("n_bytes").cast("bigint").alias("n_bytes"),
                       F.size(chunk_text("text", chunk_chars, None, compat)).cast("bigint").alias("n_chunks"))


def document_status(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One status per document: imported, failed or skipped.

    A document fails when any of its chunks cannot be stored. The answer needs only
    the document's own row, so nothing is shuffled.
    """
    chunks = chunk_text("text", chunk_chars, header_import("file"))
    stored = F.coalesce(F.forall(chunks, lambda piece: ~is_blank(piece)), F.lit(False))
    return docs.select("file", F.when(F.length(py_strip("text")) < MIN_DOCUMENT_CHARS, "skipped")
                       .when(stored, "imported").otherwise("failed").alias("status"))


def document_report(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count(F.lit(1)).alias("total"))


def chunk_report(rows: DataFrame, doc: str = "request_id") -> DataFrame:
    """Chunks stored per document and their ids in order.

    A group is one document, which was one row before it was chunked.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id")))
    return rows.groupBy(doc).agg(F.count(F.lit(1)).alias("chunks"),
                                 F.transform(ordered, lambda r: r["id"]).alias("results"))
