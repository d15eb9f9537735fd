"""Records of large text files that have no line of their own, read by byte ranges.

Whether a line end or a brace stands inside quotes depends on all that comes before it, so a
range of a file cannot tell by itself where its records end. Each range is scanned once for
what it does to the state of the text, under both assumptions of whether it begins inside
quotes. Put together in the order of a file, these give the state in which every range really
begins; a second scan then cuts each range into records. Only the pieces at the edges of
ranges, which belong to one record, are brought together.

Spark reads the ranges: a text source whose line ends are the characters at which a record
may end gives each task its part of a file, in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factstore.operators.sizing import is_small

_KEY = ["file", "block"]
_TEXT = "file string, block bigint, size bigint, text string"
_SUMMARY = "file string, block bigint, size bigint, n bigint, bytes bigint, head string, ends array<boolean>, deeper array<bigint>"
_START = "file string, block bigint, inside boolean, depth bigint, base bigint, unclosed boolean"
_PART = "file string, block bigint, seq bigint, text string, opens boolean, closes boolean"
#: Characters of a file's start that are kept to tell what it is.
_HEAD = 2_000

_STRING = r'"(?:[^"\\]|\\.)*"'
_SCALAR = rf"(?:{_STRING}|[-+.\w]+)"
#: An array, or an object whose member ``memories`` is an array behind plain members.
ARRAY_HEAD = re.compile(r"\s*\[")
ENVELOPE_HEAD = re.compile(rf'\s*\{{\s*(?:{_STRING}\s*:\s*{_SCALAR}\s*,\s*)*"memories"\s*:\s*\[')


class CsvScan:
    """Lines of CSV: a record ends with a line that does not end inside quotes."""

    line_sep = "\n"

    def __init__(self, separator: str):
        self.separator = separator

    def after(self, line: str, inside: bool) -> tuple[bool, int]:
        """Whether the line ends inside quotes; a quote opens only at the start of a cell."""
        if not inside and '"' not in line:
            return False, 0
        at = 0
        while True:
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return True, 0
                if line[at + 1:at + 2] == '"':
                    at += 2
                    continue
                inside = False
            elif line[at:at + 1] == '"':
                inside, at = True, at + 1
                continue
            at = line.find(self.separator, at)
            if at < 0:
                return False, 0
            at += 1

    def base(self, head: str) -> int:
        return 0


class JsonScan:
    """Text up to each closing brace: a record ends with the brace that closes an element."""

    line_sep = "}"
    _ESCAPE = re.compile(r"\\.", re.DOTALL)

    def after(self, text: str, inside: bool, closed: bool = True) -> tuple[bool, int]:
        """Whether the brace behind the text stands inside quotes, and how much deeper it leaves the text."""
        parts = (self._ESCAPE.sub("", text) if "\\" in text else text).split('"')
        ends = inside ^ (len(parts) % 2 == 0)
        plain = parts[int(inside)::2]
        deeper = sum(p.count("{") + p.count("[") - p.count("]") for p in plain)
        return ends, deeper - (closed and not ends)

    def base(self, head: str) -> int:
        """The depth of elements; -1 for a file that must be read as a whole."""
        return 1 if ARRAY_HEAD.match(head) else 2 if ENVELOPE_HEAD.match(head) else -1


def _lines(spark: SparkSession, paths, scan, larger: int) -> DataFrame:
    rows = spark.read.text(paths, lineSep=scan.line_sep)
    rows = rows.where(F.col("_metadata.file_size") > larger) if larger >= 0 else rows
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def _by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows one by one; those of a block follow each other in the order of the file."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _summaries(lines: DataFrame, scan) -> DataFrame:
    """What each block does to the state, begun outside quotes and begun inside."""
    def run(batches):
        now, own, done = None, None, []

        def shown(rows):
            names = [f.split()[0] for f in _SUMMARY.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

        for file, block, size, text in _by_block(batches, ["file", "block", "size", "text"]):
            if (file, block) != now:
                now = file, block
                own = {"file": file, "block": block, "size": size, "n": 0, "bytes": 0, "head": text[:_HEAD],
                       "ends": [False, True], "deeper": [0, 0]}
                done.append(own)
            own["n"] += 1
            own["bytes"] += len(text.encode())
            for begun in (0, 1):
                own["ends"][begun], more = scan.after(text, own["ends"][begun])
                own["deeper"][begun] += more
        if done:
            yield shown(done)

    return lines.mapInArrow(run, _SUMMARY)


def _starts(summaries: DataFrame, scan) -> DataFrame:
    """The state in which each block begins; a file's blocks are a few numbers each."""
    def run(group: pa.Table) -> pa.Table:
        blocks = group.sort_by("block").to_pylist()
        inside, depth, out = False, 0, []
        # With a separator behind every text they are longer than the file if the last one has none.
        unclosed = sum(b["bytes"] + b["n"] for b in blocks) > blocks[0]["size"]
        base = scan.base(blocks[0]["head"])
        for b in blocks:
            out.append({"file": b["file"], "block": b["block"], "inside": inside, "depth": depth, "base": base,
                        "unclosed": unclosed and b is blocks[-1]})
            depth += b["deeper"][inside]
            inside = b["ends"][inside]
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("base", pa.int64()),
            ("unclosed", pa.bool_())]))

    return summaries.groupBy("file").applyInArrow(run, _START)


def _parts(lines: DataFrame, starts: DataFrame, scan) -> DataFrame:
    """Records, and at the edges of blocks parts of records: ``opens`` and ``closes`` say which ends are there."""
    sep = scan.line_sep

    def run(batches):
        names = [f.split()[0] for f in _PART.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        now, out, held, seq, opens, state = None, [], [], 0, True, None

        def shown():
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        def rest(last: bool) -> None:
            """What follows the last end of a record in a block."""
            if held:
                text = "".join(held)
                out.append((*now, seq, text[:-1] if last else text, opens, False))

        for file, block, text, inside, depth, base, unclosed in _by_block(
                batches, ["file", "block", "text", "inside", "depth", "base", "unclosed"]):
            if (file, block) != now:
                if now is not None:
                    rest(state[3])
                now, held, seq = (file, block), [], 0
                state = [inside, depth, base, unclosed]
                # The text before the first record's start belongs to what an earlier block began.
                opens = not inside and (depth == base or block == 0)
            ends, more = scan.after(text, state[0])
            state[0], state[1] = ends, state[1] + more
            held.append(text + sep)
            if not ends and state[1] == base:
                out.append((file, block, seq, "".join(held), opens, True))
                held, opens, seq = [], True, seq + 1
            if len(out) >= 1000:
                yield shown()
                out = []
        if now is not None:
            rest(state[3])
        if out:
            yield shown()

    if is_small(starts):
        placed = lines.join(F.broadcast(starts), _KEY)
    else:
        # Rows of a block stay in one task, in the order that they were read in.
        row = lines.withColumn("row", F.monotonically_increasing_id())
        placed = row.join(starts, _KEY).repartition(*_KEY).sortWithinPartitions(*_KEY, "row")
    return placed.where("base >= 0").select("file", "block", "text", "inside", "depth", "base", "unclosed").mapInArrow(run, _PART)


def records(spark: SparkSession, paths, scan, larger: int = -1) -> tuple[DataFrame, DataFrame]:
    """Records ``file, block, seq, text, closed`` of the files above ``larger`` bytes, and the state of their blocks.

    ``block`` and ``seq`` give the order in a file. Text that ends without the end of a record
    is not ``closed``.
    """
    lines = _lines(spark, paths, scan, larger)
    starts = _starts(_summaries(lines, scan), scan)
    parts = _parts(lines, starts, scan)
    whole = parts.where("opens AND closes").select("file", "block", "seq", "text", F.lit(True).alias("closed"))
    # At most two parts of a block are left; a record begins with the last one that opens.
    begun = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    edges = (parts.where("NOT (opens AND closes)")
             .withColumn("owner", F.last(F.when(F.col("opens"), F.struct("block", "seq")), True).over(begun)))
    joined = edges.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("texts"), F.max("closes").alias("closed"))
    joined = joined.select("file", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq"),
                           F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("text"), "closed")
    return whole.unionByName(joined), starts
