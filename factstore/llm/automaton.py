"""Byte-pair encoding and decoding by a token automaton.

Merges are compiled one after the other. Before the first merge the automaton has one
state and an arc for each byte. A merge (u, v) of rank r adds its gadget: an arc w = uv
goes out wherever an arc u does, it enters the state that v entered, and the state that
u enters loses its arc v from then on. The automaton that remains accepts exactly the
token sequences that the merges produce, so a word has one path, and the path is its
encoding. A state differs from the one it was split from by one lost arc, so arcs are
kept as those losses (``cut``) with the ranks at which they took effect. All new words of
a slice of text follow the tables together.

A null text counts as empty and has no tokens; its decoded text is empty. Rows are
independent: ties, repeated rows and other columns, whatever their names, change
nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factstore.llm.common import text_slices, worker_state
from factstore.llm.segments import SPLIT, SegmentCoder, binaries, byte_chars

#: Bytes of text whose new words are followed together with all that this takes, and words kept.
_SLICE, _KEPT = 1_000_000, 100_000
_SHIFT = 21
_NEVER = 1 << 60
#: Words followed together, and bytes of a word that is followed alone.
_TOGETHER, _LONG_WORD = 20_000, 200


class Table:
    """Transitions as an open hash table that is asked for many keys at once."""

    def __init__(self, entries: dict[int, int]):
        self.shift = 64 - max(4, int(4 * len(entries)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int64)
        keys = np.fromiter(entries.keys(), np.int64, len(entries))
        values, at = np.fromiter(entries.values(), np.int64, len(entries)), self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several for one place the last one stays
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 for those that are not there."""
        at = self._place(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen, wanted = self.keys[at[open_]], keys[open_]
            out[open_] = np.where(seen == wanted, self.values[at[open_]], -1)
            open_ = open_[(seen != wanted) & (seen >= 0)]
        return out


class Automaton:
    def __init__(self, vocabulary: str):
        """``vocabulary``: the JSON text of a byte-level BPE vocabulary."""
        spec = json.loads(vocabulary)
        model, as_byte = spec["model"], {c: b for b, c in byte_chars()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ids = model["vocab"]
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in ids.items():
            self.labels[i] = text.encode() if text in self.specials else bytes(as_byte[c] for c in text)
        for text, i in self.specials.items():
            self.labels[i] = text.encode()
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}
        usable = {i for text, i in ids.items() if len(text) == 1}
        for rank, merge in enumerate(model["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            self._add_gadget(rank, ids[u], ids[v], ids[u + v], usable)
        self.whole = {self.labels[i]: i for i in usable}
        self.longest = max(map(len, self.whole))
        self._compile()
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(SPLIT)

    def _add_gadget(self, rank: int, u: int, v: int, w: int, usable: set[int]) -> None:
        """Arc ``w`` exists only if ``v`` could still follow ``u`` when the merge came."""
        possible = u in usable and v in usable and w not in usable and self._open(u, v)
        self.cut.setdefault(u << _SHIFT | v, rank)
        if possible:
            self.left[w], self.right[w], self.born[w] = u, v, rank
            usable.add(w)

    def _open(self, t: int, x: int) -> bool:
        """Whether arc ``x`` leaves the state that ``t`` enters.

        The state that t enters came from the one its right part entered when t was made,
        and x left wherever its left part did when x was made; so any loss of a part by a
        part that came before these makings closes the arc.
        """
        born, cut = self.born, self.cut
        z, before_z = t, _NEVER
        while z >= 0:
            y, before_y = x, _NEVER
            while y >= 0:
                rank = cut.get(z << _SHIFT | y)
                if rank is not None and rank < before_z and rank <= before_y:
                    return False
                before_y, y = born[y], self.left[y]
            before_z, z = born[z], self.right[z]
        return True

    def _compile(self) -> None:
        """The tables that many words follow at once: bytes of labels, lost arcs, and parts."""
        step, token_at = {}, [-1]
        for label, i in self.whole.items():
            node = 0
            for b in label:
                node = step.setdefault(node << 8 | b, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = i
        self.steps, self.token_at, self.cuts = Table(step), np.array(token_at), Table(self.cut)
        self.lengths = np.array([len(x) for x in self.labels])
        self.lefts, self.rights, self.births = (np.array(x) for x in (self.left, self.right, self.born))

    def _all_open(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``_open`` for many pairs."""
        good = np.ones(len(t), bool)
        z, before_z, rows = t, np.full(len(t), _NEVER), np.arange(len(t))
        while len(rows):
            y, before_y, own, left = x[rows], np.full(len(rows), _NEVER), np.arange(len(rows)), z
            while len(own):
                rank = self.cuts.get(left << _SHIFT | y)
                closed = (rank >= 0) & (rank < before_z[own]) & (rank <= before_y)
                good[rows[own[closed]]] = False
                before_y, y = self.births[y], self.lefts[y]
                go = ~closed & (y >= 0)
                own, left, y, before_y = own[go], left[go], y[go], before_y[go]
            before_z, z = self.births[z], self.rights[z]
            go = good[rows] & (z >= 0)
            rows, z, before_z = rows[go], z[go], before_z[go]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Follow the arcs over the bytes of all words side by side.

        Every prefix of a word has one path, so one arc is the last before each place. The
        places of all words are taken in step, and each opens those that its arcs reach.
        """
        out: list[list[int]] = []
        short = [w for w in words if len(w) <= _LONG_WORD]
        for at in range(0, len(short), _TOGETHER):
            out += self._side_by_side(short[at:at + _TOGETHER])
        if len(short) == len(words):
            return out
        paths = iter(out)
        return [next(paths) if len(w) <= _LONG_WORD else self._search(w) for w in words]

    def _side_by_side(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        place = np.arange(len(text)) - np.repeat(starts, sizes + 1)
        room = np.repeat(sizes, sizes + 1) - place
        # All labels that stand anywhere in the words.
        rows, depth, found = np.flatnonzero(room), 0, []
        node = np.zeros(len(rows), np.int64)
        while len(rows):
            node = self.steps.get(node << 8 | text[rows + depth])
            depth += 1
            go = node >= 0
            rows, node = rows[go], node[go]
            token = self.token_at[node]
            some = token >= 0
            found.append((rows[some], token[some], np.full(int(some.sum()), depth)))
            go = room[rows] > depth
            rows, node = rows[go], node[go]
        at, token, size = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(place[at], kind="stable")
        at, token, size = at[order], token[order], size[order]
        cuts = np.searchsorted(place[at], np.arange(int(sizes.max()) + 1))
        last = np.full(len(text) + 1, -1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            new = last[at[a:b] + size[a:b]] < 0
            source, arc, to = at[a:b][new], token[a:b][new], (at[a:b] + size[a:b])[new]
            if a:
                way = self._all_open(last[source], arc)
                arc, to = arc[way], to[way]
            last[to] = arc
        # Back along the last arcs.
        lengths, own, now, owners, tokens = self.lengths, np.arange(len(words)), ends, [], []
        while len(own):
            arc = last[now]
            owners.append(own)
            tokens.append(arc)
            now = now - lengths[arc]
            go = now > starts[own]
            own, now = own[go], now[go]
        owner, token = np.concatenate(owners[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(owner, kind="stable")
        cuts, token = np.cumsum([0, *np.bincount(owner, minlength=len(words))]).tolist(), token[order].tolist()
        return [token[a:b] for a, b in zip(cuts, cuts[1:])]

    def _search(self, word: bytes) -> list[int]:
        """The path of a long word; a trial that cannot go on goes back to its last choice.

        Each prefix has one last arc, so a place that was left once is never entered again.
        """
        left = bytearray(len(word))
        path, ends, choices = [], [0], []
        while ends[-1] < len(word):
            at = ends[-1]
            if len(choices) < len(ends):
                labels = (word[at:at + n] for n in range(min(self.longest, len(word) - at), 0, -1))
                choices.append(iter([(self.whole[x], len(x)) for x in labels if x in self.whole]))
            for t, size in choices[-1]:
                end = at + size
                if not (end < len(word) and left[end]) and (not path or self._open(path[-1], t)):
                    path.append(t)
                    ends.append(end)
                    break
            else:
                left[ends.pop()] = 1
                choices.pop()
                path.pop()
        return path

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) >= _KEPT:
            self.words.clear()
        known, found = self.words, [self.split.findall(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in known]
        own = dict(zip(new, self.encode_words([w.encode() for w in new]))) if new else {}
        out = [np.array(list(chain.from_iterable([own[w] if w in own else known[w] for w in f])), "<u4") for f in found]
        known.update((w, p) for w, p in own.items() if len(p) < 8)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def decode_runs(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The texts of many runs of ids."""
        raw = b"".join(map(self.labels.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        texts = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(ends[starts].astype(np.int32)), pa.py_buffer(raw)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # some run is not the whole of its characters
            cuts = ends[starts].tolist()
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())
        return texts


def _coder(vocabulary: str, name: str) -> tuple[Automaton, SegmentCoder]:
    def make():
        automaton = Automaton(vocabulary)
        return automaton, SegmentCoder(automaton.encode_all, automaton.lengths, automaton.specials)
    return worker_state(f"automaton-{name}", make)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of each text.

    ``vocabulary`` is the JSON text of a byte-level BPE vocabulary, whose size does not
    depend on the documents; special strings inside texts are their single ids.
    """
    name = hashlib.sha256(vocabulary.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = _coder(vocabulary, name)
        for batch, texts in text_slices(batches, _SLICE):
            ids, starts = coder.pack(texts)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(starts)), binaries(ids, starts)],
                                  ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with the text ``decoded`` from ``ids`` (null: empty); special ids give their strings."""
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    columns = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _ = _coder(vocabulary, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [automaton.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in part.column("ids")]
                yield pa.record_batch([*(part.column(c) for c in columns), pa.array(texts, pa.string())],
                                      [*columns, "decoded"])

    kept = encoded.select(*columns)
    return kept.mapInArrow(run, StructType([*kept.schema, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task holds one automaton."""
    name = hashlib.sha256(vocabulary.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, coder = _coder(vocabulary, name)
        for batch, texts in text_slices(batches, _SLICE):
            ids, starts = coder.pack(texts)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(starts)), binaries(ids, starts),
                                   automaton.decode_runs(ids, starts)], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, decode and show both by their SHA-256."""
    both = round_trip(docs, vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
