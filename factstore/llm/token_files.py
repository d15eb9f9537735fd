"""Token ids in files that give any token without decoding a block.

Ids are written as directly addressable codes: the low byte of every id stands in level
0, and where more bytes follow, a bit of the level's continuation bitmap is set and the
next byte stands in the next level. A directory of counts before every 512 bits gives the
rank of a bit, which is the place of the id in the next level; so one token costs a few
bytes of each level it reaches, and a run of tokens is a run in each level.

Rows are written in ascending order of ``doc_id`` (nulls first, ties by text), each with
the end id after its ids; a null or empty text has only the end id. Repeated rows are all
written. Extra columns are ignored. An empty table gives no files and an empty manifest.

A file is written under a name of the attempt and then moved to its place, so a task that
is run again replaces a file by the same content.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from factstore.llm.common import text_slices, worker_state
from factstore.llm.token_counts import library_coder, merges_by_id, tokenizer_digest

_MAGIC = b"DACT"
_BLOCK = 512
_HEAD = "<4sIQQ4Q"
_MANIFEST = "file_no bigint, path string, n_docs bigint, n_tokens bigint"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Tokens of a file at most, unless one document has more.
TOKENS_PER_FILE = 4_000_000
#: Files that a task reads back.
FILES_PER_TASK = 4


def pack(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """One file: head, document ids, their validity, their starts, and the four levels."""
    levels, rest = [], ids.astype(np.uint32)
    for _ in range(4):
        levels.append(rest)
        rest = rest[rest > 255] >> 8
    parts = [struct.pack(_HEAD, _MAGIC, 1, len(doc_ids), len(ids), *map(len, levels)),
             np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
             np.array([d is not None for d in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for values in levels:
        bits = np.packbits(values > 255, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (_BLOCK // 8)))
        ones = _ONES[bits].reshape(-1, _BLOCK // 8).sum(1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        parts += [(values & 255).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
    return b"".join(parts)


class TokenFile:
    """Reads ids from a file through ``read(place, size)`` and fetches only what it needs."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, _, self.n_docs, self.n_tokens, *counts = struct.unpack(_HEAD, read(0, struct.calcsize(_HEAD)))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        self._docs, at = at, at + 17 * self.n_docs + 8
        self.levels = []
        for n in counts:
            blocks = -(-n // _BLOCK)
            self.levels.append((at, at + n, at + n + blocks * _BLOCK // 8))
            at += n + blocks * _BLOCK // 8 + 4 * (blocks + 1)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids, and the starts of their tokens with the end of the last."""
        n = self.n_docs
        raw = self.read(self._docs, 17 * n + 8)
        ids, valid = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        return ([i if v else None for i, v in zip(ids.tolist(), valid.tolist())],
                np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i``: the directory's count and a part of one block."""
        _, bits, directory = self.levels[level]
        block, rest = divmod(i, _BLOCK)
        count = struct.unpack("<I", self.read(directory + 4 * block, 4))[0]
        if rest:
            part = np.frombuffer(self.read(bits + block * _BLOCK // 8, -(-rest // 8)), np.uint8)
            count += int(np.unpackbits(part, bitorder="little")[:rest].sum())
        return count

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``: a run in level 0, and the run it leads to in each next level."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        ids = np.zeros(end - start, np.uint32)
        places = np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start == end:
                break
            ids[places] |= np.frombuffer(self.read(chunks + start, end - start), np.uint8).astype(np.uint32) << (8 * level)
            first = start // 8
            raw = np.frombuffer(self.read(bits + first, -(-end // 8) - first), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[start - 8 * first:end - 8 * first].astype(bool)
            places = places[more]
            start = self._rank(level, start) if len(places) else 0
            end = start + len(places)
        return ids


def open_file(path: str) -> TokenFile:
    """A file for random access, on any store that Arrow reads."""
    store, place = fs.FileSystem.from_uri(path)
    file = store.open_input_file(place)

    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    return TokenFile(read)


def _put(path: str, content: bytes) -> None:
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    trial = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(trial) as out:
        out.write(content)
    store.move(trial, place)


def write(docs: DataFrame, tokenizer: tuple[str, bytes], folder: str, end_id: int) -> DataFrame:
    """Encode ``docs`` into files below ``folder``; returns the manifest, one row for each file."""
    name, ranked = tokenizer_digest(tokenizer), merges_by_id(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(f"library-{name}", lambda: library_coder(tokenizer[1], ranked))
        part, files = TaskContext.get().partitionId(), 0
        doc_ids, sizes, held, tokens = [], [], [], 0

        def flush():
            ids, starts = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            path = f"{folder}/part-{part:06d}-{files:06d}.dac"
            _put(path, pack(ids, doc_ids, starts))
            return pa.record_batch([[part * 1_000_000 + files], [path], [len(doc_ids)], [len(ids)]],
                                   ["file_no", "path", "n_docs", "n_tokens"])

        for batch, texts in text_slices(batches):
            ids, starts = coder.pack(texts)
            ids, starts = np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))
            own, at = batch.column("doc_id").to_pylist(), 0
            while at < len(own):
                # As many documents as the file has room for; one that is too long is a file of its own.
                end = int(np.searchsorted(starts, starts[at] + TOKENS_PER_FILE - tokens, "right")) - 1
                if end <= at and held:
                    yield flush()
                    files += 1
                    doc_ids, sizes, held, tokens = [], [], [], 0
                    continue
                end = max(end, at + 1)
                doc_ids += own[at:end]
                sizes.append(np.diff(starts[at:end + 1]))
                held.append(ids[starts[at]:starts[end]])
                tokens += int(starts[end] - starts[at])
                at = end
        if held:
            yield flush()

    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document from the files: ``doc_id, start, n_tokens, ids`` (packed), ``ids_crc32``.

    ``start`` counts the tokens of all documents before it; the sum over files runs on
    their narrow manifest.
    """
    before = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file_no", "path", F.coalesce(before, F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                file = open_file(path)
                doc_ids, starts = file.documents()
                for at in range(0, len(doc_ids), 2000):
                    cuts = starts[at:at + 2001]
                    run_of = file.tokens(int(cuts[0]), int(cuts[-1])).astype("<u4").tobytes()
                    ids = [run_of[4 * (a - cuts[0]):4 * (b - cuts[0])] for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.record_batch(
                        [pa.array(doc_ids[at:at + 2000], pa.int64()), pa.array(cuts[:-1] + first, pa.int64()),
                         pa.array(np.diff(cuts), pa.int64()), pa.array(ids, pa.binary()),
                         pa.array(map(zlib.crc32, ids), pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    # Their number is a count of the manifest's rows.
    return (placed.repartition(max(1, -(-manifest.count() // FILES_PER_TASK)), "file_no")
            .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint"))
