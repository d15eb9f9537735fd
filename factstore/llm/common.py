"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factstore.session import shared_folder

#: Bytes of text that a task holds decoded at a time.
SLICE_BYTES = 4_000_000


def worker_state(key: str, make: Callable[[], object]):
    """An object that later tasks of the same Python worker find again, until another key takes its place.

    Functions travel with their code, so module globals are new in every task; the
    place for what may be kept is a module of its own. A worker keeps one object, so that
    the stages of a long job do not add theirs up. A new worker builds it anew.
    """
    kept = sys.modules.setdefault("factstore_worker_state", types.ModuleType("factstore_worker_state")).__dict__
    if kept.get("key") != key:
        kept.pop("held", None)
        pa.default_memory_pool().release_unused()
        kept["held"], kept["key"] = make(), key
    return kept["held"]


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a later loss recomputes nothing before it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text() -> Column:
    """``doc_id`` as text; a null id counts as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def fold(parts: int) -> Column:
    """The part of a document by crc32 of its id."""
    return F.crc32(F.encode(id_text(), "UTF-8")) % parts


def fresh_name(columns: Iterable[str], base: str) -> str:
    """A column name that no table holds yet."""
    taken = {c.lower() for c in columns}
    return base if base not in taken else f"{base}_{uuid.uuid4().hex[:8]}"


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of bounded text, each with its texts (null: empty).

    A text longer than the bound is a slice of its own.
    """
    for batch in batches:
        at, texts, held = 0, [], 0
        for i, text in enumerate(batch.column(column)):
            text = text.as_py() or ""
            if texts and held + len(text) > SLICE_BYTES:
                yield batch.slice(at, len(texts)), texts
                at, texts, held = i, [], 0
            texts.append(text)
            held += len(text)
        if texts:
            yield batch.slice(at, len(texts)), texts


def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """As ``slices`` of ``size`` bytes, with the texts as an Arrow array (null: empty)."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at), texts.slice(at, end - at)
            at = end


def filter_rows(docs: DataFrame, masks: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Keep the rows whose text passes; all columns, whatever their names, stay as they are."""
    columns = docs.columns

    def run(batches):
        for batch, texts in slices(batches, "text"):
            yield batch.filter(pa.array(masks(texts), pa.bool_())).select(columns)

    return docs.mapInArrow(run, docs.schema)
