"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, in the order of their turns, are edited at least cost until the
initials of their roles read ``(s?(ua)+)?``: a row is kept (0), given the role user or
assistant (2) or deleted (3, which is a must for blank and repeated rows), rows without text
may be inserted (2), and a truncated row that stays adds 1. The audit is the initials of the
edits in order; of all cheapest audits it is the least in ASCII.

Costs run backwards over four states (nothing yet, after s, after u, after a). A long
conversation is cut into chunks, and each starts from a speculative cost vector at its end.
Fix-up passes hand every chunk the vector that the chunk behind it reached; the chunk runs
again from there, but only until its vector differs from the earlier one by a constant, as
from then on both lead to the same edits. Vectors are therefore kept less their minimum, and
equal ones are parallel. Where a few passes do not settle all chunks, the rest are run from
one vector per state, which answers for every vector, and joined in order. The stitched
backward costs drive the trace: in each state the least initial whose cost lies on a cheapest
path is taken, and a chunk's four possible entries are composed into the one that holds.

Rows: a blank row has no character but white space (``[\\x20\\x09-\\x0D]``); a duplicate has
the role and text of an earlier row; a truncated one ends, white space aside, in none of
``.!?``. The first fault counts. Null roles and texts read as one space. Rows of one turn
are taken by role and text, null turns first. A role's initial is its first character; an
empty role, like any other initial than s, u and a, cannot be kept. Null ``conv_id`` is a
conversation of its own. Repeated rows are duplicates, extra columns do not matter, and an
empty table gives an empty result. A column ``copies``, if the caller has marked rows with
``with_copies``, says how often a row stands there; a conversation whose rows all have none
has zeros, an empty audit and no repaired rows.

Conversations up to ``CHUNK_ROWS`` rows and ``CHUNK_BYTES`` of text go to one task each as
they are; longer ones are dealt by ranges of turns, equal rows folded first, and cut into chunks. The digest of
a repaired conversation is that of one text, so its lines pass one task in order, which
holds no more than the state of the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from factstore.llm.common import saved
from factstore.operators.sizing import broadcast_if_small

#: Rows and bytes of text of a conversation, or of a chunk, that a task holds.
CHUNK_ROWS, CHUNK_BYTES = 10_000, 8_000_000
#: Fix-up passes before the chunks that are left run from one vector per state.
PASSES = 6

_BLANK = " \t\n\x0b\x0c\r"
_KEEP, _REROLE, _DELETE, _INSERT = 0, 2, 3, 2
_FAR = 1 << 40
# States: nothing yet, after s, after u, after a.
_STATES, _START = range(4), 0
_INSERTED = (2, 2, 3, 2)
_END = (0, 4, 2, 0)
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NAMES = {2: "user", 3: "assistant"}
_INITIALS = "sua?"


def code_of(role: str, truncated: bool) -> int:
    """A row that may stay, as the trellis sees it."""
    initial = role[:1]
    return 2 * (_INITIALS.index(initial) if initial and initial in "sua" else 3) + truncated


def _options(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state, least initial first: (initial, cost, next state)."""
    initial, truncated = _INITIALS[code >> 1], code & 1
    out = [("D", _DELETE, state)]
    kept = _KEPT.get((state, initial))
    if kept is not None:
        out.append(("K", _KEEP + truncated, kept))
    return out + [("R", _REROLE + truncated, _INSERTED[state])]


def _with_inserts(edited: list[int]) -> list[int]:
    """More than two inserts at a place never pay, as they come back to a state for four."""
    one = [min(edited[s], _INSERT + edited[_INSERTED[s]]) for s in _STATES]
    return [min(edited[s], _INSERT + one[_INSERTED[s]]) for s in _STATES]


def _reduced(vector: list[int]) -> tuple[int, ...]:
    least = min(vector)
    return tuple(min(v - least, _FAR) for v in vector)


class Trellis:
    """Cost vectors and edits; the few vectors less their minimum that there are recur, so they are kept."""

    def __init__(self):
        self._before, self._step = {}, {}

    def before(self, behind: tuple[int, ...], code: int) -> tuple[int, ...]:
        """Costs to the end before a row, less their minimum, from those behind it."""
        found = self._before.get((behind, code))
        if found is None:
            edited = [min(cost + behind[to] for _, cost, to in _options(code, s)) for s in _STATES]
            found = self._before[behind, code] = _reduced(_with_inserts(edited))
        return found

    def step(self, behind: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
        """The least edits for a row, with the inserts before it, and the state behind it."""
        found = self._step.get((behind, code, state))
        if found is None:
            edited = [min(cost + behind[to] for _, cost, to in _options(code, s)) for s in _STATES]
            found = self._step[behind, code, state] = self._least(_with_inserts(edited), behind, code, state)
        return found

    @staticmethod
    def _least(costs: list[int], behind: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
        letters = ""
        while True:
            options = _options(code, state)
            for letter, cost, to in [options[0], ("I", _INSERT, None), *options[1:]]:
                if letter == "I":
                    if _INSERT + costs[_INSERTED[state]] == costs[state]:
                        letters, state = letters + "I", _INSERTED[state]
                        break
                elif cost + behind[to] == costs[state]:
                    return letters + letter, to

    def backward(self, codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
        """The vectors before each row and, last, behind all."""
        out = [end]
        for code in reversed(codes):
            out.append(self.before(out[-1], code))
        return out[::-1]

    def fix_up(self, codes: bytes, old: tuple[int, ...], new: tuple[int, ...]) -> tuple[tuple[int, ...] | None, int]:
        """The vector before the chunk when ``new`` stands behind it, and the rows run again.

        None says that it became parallel to the one that ``old`` led to, so nothing changes.
        """
        for done, code in enumerate(reversed(codes)):
            if old == new:
                return None, done
            old, new = self.before(old, code), self.before(new, code)
        return (None if old == new else new), len(codes)

    def trace(self, codes: bytes, end: tuple[int, ...], state: int) -> tuple[list[str], int]:
        """The edits at each row, and the state behind the last."""
        vectors, out = self.backward(codes, end), []
        for place, code in enumerate(codes):
            letters, state = self.step(vectors[place + 1], code, state)
            out.append(letters)
        return out, state


def closing(state: int) -> str:
    """Inserts that end a conversation."""
    return ("", "II", "I", "")[state]


class Rows:
    """Consecutive rows of one conversation: their faults, and what repair makes of them."""

    def __init__(self):
        self.roles, self.texts, self.turns, self.copies, self.faults, self.bytes = [], [], [], [], [], 0

    def add(self, turn, role: str, text: str, copies: int, first: bool) -> None:
        """``first``: no earlier row has this role and text."""
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.bytes += len(text)
        bare = text.rstrip(_BLANK)
        self.faults.append("b" if not bare else "d" if not first else "t" if bare[-1] not in ".!?" else "-")

    def codes(self) -> bytes:
        """The rows that may stay."""
        return bytes(code_of(r, f == "t") for r, f in zip(self.roles, self.faults) if f in "t-")

    def counts(self) -> dict:
        """What is counted, with the edges that the neighbouring chunks need."""
        out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        earlier = None
        for role, copies, fault in zip(self.roles, self.copies, self.faults):
            out["blank"] += copies if fault == "b" else 0
            out["duplicate"] += copies if fault == "d" else copies - 1 if fault != "b" else 0
            out["truncated"] += fault == "t"
            out["illegal"] += copies - 1 + (earlier is not None and illegal(earlier, role[:1]))
            earlier = role[:1]
        turns = [t for t in self.turns if t is not None]
        out["turns"] = len(set(turns))
        out["first_turn"], out["last_turn"] = (turns[0], turns[-1]) if turns else (None, None)
        out["first_initial"], out["last_initial"] = (self.roles[0][:1], earlier) if self.roles else (None, None)
        return out

    def repaired(self, edits: list[str], state: int, end: str) -> tuple[str, int, list[tuple[int, str, str]]]:
        """Audit, cost and the rows that stay: (row, role, text)."""
        audit, cost, lines, edit = [], 0, [], iter(edits)
        for row, (role, text, copies, fault) in enumerate(zip(self.roles, self.texts, self.copies, self.faults)):
            extra = copies
            if fault in "t-":
                extra -= 1
                letters = next(edit)
                audit.append(letters)
                for letter in letters:
                    if letter == "D":
                        cost += _DELETE
                        continue
                    if letter == "K":
                        state, name = _KEPT[state, role[:1]], role
                    else:
                        state = _INSERTED[state]
                        name = _NAMES[state]
                    cost += {"K": _KEEP, "R": _REROLE, "I": _INSERT}[letter] + (letter != "I" and fault == "t")
                    lines.append((row, name, "" if letter == "I" else text))
            audit.append("D" * extra)
            cost += _DELETE * extra
        for _ in end:
            state = _INSERTED[state]
            cost += _INSERT
            lines.append((len(self.roles), _NAMES[state], ""))
        return "".join(audit) + end, cost, lines


def illegal(one: str, other: str) -> bool:
    return one + other not in ("su", "ua", "au")


def damaged(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with a fault planted by the hash of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    return messages.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
        .alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def with_copies(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``, each row as it stands."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return messages.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                           F.lit(1).cast("bigint").alias("copies"))


_REPORT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "repaired_sha256 string")
_COUNTS = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn {t}, last_turn {t}, "
           "first_initial string, last_initial string")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Sorted rows ``(conv_id, turn, role, text, copies, ...)`` one by one, without the conversation's end being known."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            yield from zip(*(c.to_pylist() for c in part.columns))


def _digest(lines: list[tuple[int, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest()


def _short(rows: DataFrame, schema: str) -> DataFrame:
    """Conversations that a task holds as a whole."""
    def finish(trellis: Trellis, conv, own: Rows) -> tuple:
        counts = own.counts()
        edits, state = trellis.trace(own.codes(), _END, _START)
        audit, cost, lines = own.repaired(edits, _START, closing(state))
        gaps = counts["last_turn"] - counts["first_turn"] + 1 - counts["turns"] if counts["turns"] else 0
        return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, _digest(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, own, seen, id_type, trellis = [], None, None, set(), None, Trellis()

        def shown():
            columns = list(zip(*held))
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                   ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, role, text, copies in _by_conversation([batch]):
                if own is None or conv != now:
                    if own is not None:
                        held.append(finish(trellis, now, own))
                    now, own, seen = conv, Rows(), set()
                    if len(held) == 1000:
                        yield shown()
                        held = []
                if copies:
                    own.add(turn, role, text, copies, (role, text) not in seen)
                    seen.add((role, text))
        if own is not None:
            held.append(finish(trellis, now, own))
        if held:
            yield shown()

    # An entry of the sort for each column: null conversations and turns first.
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, schema)


def _cut(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Rows of long conversations in order, with ``chunk`` (ascending within a conversation) and ``pos``.

    Equal rows are one row with their number; ``first`` says that no earlier row is alike.
    """
    folded = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keyed = folded.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    # The least turn, nulls before all; a repeated text is one row for each task here.
    begun = (keyed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
             .agg(F.min(F.struct("turn")).alias("begun")))
    marked = keyed.join(begun, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    marked = marked.select("conv_id", "turn", "role", "text", "copies",
                           F.col("turn").eqNullSafe(F.col("begun.turn")).alias("first"))
    ordered = (marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 100))
               .sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, now, begun, pos, held = TaskContext.get().partitionId() << 32, None, False, 0, 0
        for batch in batches:
            chunks, places = [], []
            convs, sizes = batch.column("conv_id").to_pylist(), [len(t.as_py()) for t in batch.column("text")]
            for conv, size in zip(convs, sizes):
                if not begun or conv != now or pos == chunk_rows or held + size > chunk_bytes and pos:
                    chunk, pos, held = chunk + begun, 0, 0
                now, begun = conv, True
                chunks.append(chunk)
                places.append(pos)
                pos, held = pos + 1, held + size
            yield pa.record_batch([*batch.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())],
                                  [*batch.schema.names, "chunk", "pos"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    return saved(ordered.mapInArrow(run, f"{fields}, chunk bigint, pos int"), "turns")


def _rows_of(group: pa.Table) -> Rows:
    own = Rows()
    for row in group.sort_by("pos").select(["turn", "role", "text", "copies", "first"]).to_pylist():
        own.add(*row.values())
    return own


def _settled(chunks: DataFrame, passes: int) -> DataFrame:
    """``conv_id, chunk, behind``: the vector behind each chunk, from ``chunks`` with their ``codes``."""
    spark = chunks.sparkSession
    kind = chunks.schema["conv_id"].dataType.simpleString()
    row = f"conv_id {kind}, chunk bigint, behind array<bigint>, ahead array<bigint>, reran bigint"
    end = F.array(*map(F.lit, _END)).cast("array<bigint>")

    def speculate(batches):
        trellis = Trellis()
        for batch in batches:
            ahead = [list(trellis.backward(c, _END)[0]) for c in batch.column("codes").to_pylist()]
            n = batch.num_rows
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array([list(_END)] * n, pa.list_(pa.int64())),
                                   pa.array(ahead, pa.list_(pa.int64())), pa.array([0] * n, pa.int64())],
                                  ["conv_id", "chunk", "behind", "ahead", "reran"])

    def rerun(batches):
        trellis = Trellis()
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                found, r["reran"] = trellis.fix_up(r["codes"], tuple(r["behind"]), tuple(r["wanted"]))
                r["ahead"], r["behind"] = list(found) if found else r["ahead"], r["wanted"]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("conv_id", "chunk", "behind", "ahead", "reran")} for r in rows],
                                             schema=pa.schema([batch.schema.field("conv_id"), ("chunk", pa.int64()),
                                                               ("behind", pa.list_(pa.int64())), ("ahead", pa.list_(pa.int64())),
                                                               ("reran", pa.int64())]))

    state = saved(chunks.select("conv_id", "chunk", "codes").mapInArrow(speculate, row), "vectors")
    order = Window.partitionBy("conv_id").orderBy("chunk")
    codes = chunks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "codes")
    for _ in range(passes):
        wanted = state.withColumn("wanted", F.coalesce(F.lead("ahead").over(order), end))
        stale = wanted.where(F.col("wanted") != F.col("behind"))
        if stale.isEmpty():
            return state.select("conv_id", "chunk", "behind")
        again = stale.join(codes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
        again = again.select("conv_id", "chunk", "behind", "ahead", "wanted", "codes").mapInArrow(rerun, row)
        state = saved(wanted.where(F.col("wanted") == F.col("behind")).drop("wanted").unionByName(again), "vectors")

    def unit(batches):
        for batch in batches:
            found = []
            for codes in batch.column("codes").to_pylist():
                # Costs from each state to each state, which hold for every vector behind.
                table = [[0 if s == t else _FAR for t in _STATES] for s in _STATES]
                for code in reversed(codes):
                    edited = [[min(cost + table[to][t] for _, cost, to in _options(code, s)) for t in _STATES] for s in _STATES]
                    columns = [_with_inserts([edited[s][t] for s in _STATES]) for t in _STATES]
                    least = min(map(min, columns))
                    table = [[min(columns[t][s] - least, _FAR) for t in _STATES] for s in _STATES]
                found.append([v for line in table for v in line])
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array(found, pa.list_(pa.int64()))],
                                  ["conv_id", "chunk", "costs"])

    def chain(batches):
        now, vector = object(), None
        for batch in batches:
            behind = []
            for conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist()):
                if conv != now:
                    now, vector = conv, _END
                behind.append(list(vector))
                vector = _reduced([min(costs[4 * s + t] + vector[t] for t in _STATES) for s in _STATES])
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array(behind, pa.list_(pa.int64()))],
                                  ["conv_id", "chunk", "behind"])

    every = chunks.select("conv_id", "chunk", "codes").mapInArrow(unit, f"conv_id {kind}, chunk bigint, costs array<bigint>")
    return (every.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
            .mapInArrow(chain, f"conv_id {kind}, chunk bigint, behind array<bigint>"))


def _long(rows: DataFrame, schema: str, chunk_rows: int, chunk_bytes: int, passes: int) -> DataFrame:
    """Conversations in chunks."""
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    cut = _cut(rows, chunk_rows, chunk_bytes)

    def summarise(group: pa.Table) -> pa.Table:
        own = _rows_of(group)
        counts = {"conv_id": group["conv_id"][0].as_py(), "chunk": group["chunk"][0].as_py(), **own.counts(), "codes": own.codes()}
        return pa.Table.from_pylist([counts], schema=summary)

    id_arrow, turn_arrow = ({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in (kind, turn))
    summary = pa.schema([("conv_id", id_arrow), ("chunk", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
                         ("first_turn", turn_arrow), ("last_turn", turn_arrow), ("first_initial", pa.string()),
                         ("last_initial", pa.string()), ("codes", pa.binary())])
    chunks = saved(cut.groupBy("conv_id", "chunk").applyInArrow(
        summarise, f"conv_id {kind}, chunk bigint, {_COUNTS.format(t=turn)}, codes binary"), "chunks")
    behind = _settled(chunks, passes)

    # Each chunk's way from every state, then the ways in order.
    def ways(batches):
        trellis = Trellis()
        for batch in batches:
            found = [[trellis.trace(codes, tuple(end), s)[1] for s in _STATES]
                     for codes, end in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist())]
            yield pa.record_batch([*(batch.column(c) for c in ("conv_id", "chunk", "behind")), pa.array(found, pa.list_(pa.int32()))],
                                  ["conv_id", "chunk", "behind", "leaves"])

    def enter(batches):
        now, state = object(), None
        for batch in batches:
            states = []
            for conv, leaves in zip(batch.column("conv_id").to_pylist(), batch.column("leaves").to_pylist()):
                if conv != now:
                    now, state = conv, _START
                states.append(state)
                state = leaves[state]
            yield pa.record_batch([*(batch.column(c) for c in ("conv_id", "chunk", "behind")), pa.array(states, pa.int32())],
                                  ["conv_id", "chunk", "behind", "state"])

    met = (behind.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "behind")
           .join(chunks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).select("conv_id", "chunk", "behind", "codes"))
    entered = (met.mapInArrow(ways, f"conv_id {kind}, chunk bigint, behind array<bigint>, leaves array<int>")
               .repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
               .mapInArrow(enter, f"conv_id {kind}, chunk bigint, behind array<bigint>, state int"))
    last = Window.partitionBy("conv_id").orderBy("chunk")
    entered = saved(entered.withColumn("last", F.lead("chunk").over(last).isNull()), "entries")

    def repair_chunk(group: pa.Table, entry: pa.Table) -> pa.Table:
        own, how = _rows_of(group), entry.to_pylist()[0]
        edits, state = Trellis().trace(own.codes(), tuple(how["behind"]), how["state"])
        audit, cost, lines = own.repaired(edits, how["state"], closing(state) if how["last"] else "")
        # The first row carries what is said of the chunk.
        n = len(lines) + 1
        return pa.table({"conv_id": pa.array([how["conv_id"]] * n, id_arrow), "chunk": pa.array([how["chunk"]] * n, pa.int64()),
                         "place": pa.array(range(n), pa.int32()), "audit": pa.array([audit, *[None] * (n - 1)], pa.string()),
                         "cost": pa.array([cost, *[None] * (n - 1)], pa.int64()),
                         "line": pa.array([None, *[f"{role}:{text}" for _, role, text in lines]], pa.string())})

    cell = ["conv_id", "chunk"]
    entries = entered.select(*[F.col(c).alias(c) for c in entered.columns])
    edited = saved(cut.groupBy(*cell).cogroup(entries.groupBy(*cell)).applyInArrow(
        repair_chunk, f"conv_id {kind}, chunk bigint, place int, audit string, cost bigint, line string"), "edited")

    def digest(batches):
        now, sha, first = None, None, True
        out = lambda: pa.record_batch([pa.array([now], id_arrow), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
                if sha is None or conv != now:
                    if sha is not None:
                        yield out()
                    now, sha, first = conv, hashlib.sha256(), True
                if line.is_valid:
                    sha.update(("" if first else "\n").encode() + line.as_py().encode())
                    first = False
        if sha is not None:
            yield out()

    digests = (edited.select("conv_id", "chunk", "place", "line").repartition("conv_id")
               .sortWithinPartitions("conv_id", "chunk", "place").select("conv_id", "line")
               .mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string"))
    audits = (edited.where("place = 0").groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("chunk", "audit"))).alias("parts"))
        .select("conv_id", "cost", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit")))
    # Neighbouring chunks may share a turn, and their edge rows make a pair.
    order = Window.partitionBy("conv_id").orderBy("chunk")
    earlier_turn = F.last("last_turn", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pair = F.concat(F.lag("last_initial").over(order), F.col("first_initial"))
    edges = chunks.select("*", (F.col("turns") - F.coalesce((earlier_turn == F.col("first_turn")).cast("bigint"), F.lit(0))).alias("own_turns"),
                          F.when(pair.isin("su", "ua", "au"), 0).when(pair.isNull(), 0).otherwise(1).alias("edge"))
    counts = edges.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("edge")).alias("illegal"),
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("own_turns"), F.lit(0)).cast("bigint").alias("gaps"))
    same = lambda df, name: df.withColumnRenamed("conv_id", name)
    joined = (counts.join(same(audits, "a"), F.col("conv_id").eqNullSafe(F.col("a")))
              .join(same(digests, "b"), F.col("conv_id").eqNullSafe(F.col("b"))))
    return joined.select(*[f.split()[0] for f in schema.split(", ")])


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, passes: int = PASSES) -> DataFrame:
    """One row for each ``conv_id`` of ``rows`` (``damaged`` or ``with_copies``) with its faults, edits and digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_REPORT}"
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("copies") > 0, F.octet_length("text"))).alias("b"))
    long = saved(sizes.where((F.col("n") > chunk_rows) | (F.col("b") > chunk_bytes)).select(F.col("conv_id").alias("long_id")), "long")
    if long.isEmpty():
        return _short(rows, schema)
    sent, is_long = broadcast_if_small(long), F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _short(rows.join(sent, is_long, "left_anti"), schema)
    return short.unionByName(_long(rows.join(sent, is_long, "left_semi"), schema, chunk_rows, chunk_bytes, passes))
