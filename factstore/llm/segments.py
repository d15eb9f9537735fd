"""Whole texts to token ids through a bounded store of the segments that recur.

A byte-level split never joins a blank with what stands before it when something
other than white space follows the blank, so a text may be cut there and each cut
piece encoded by itself. Pieces recur; a worker encodes each new one once. Texts are
cut, and their pieces told apart, as Arrow arrays; the store is asked once for each
distinct piece of a slice, and the ids of all texts are gathered together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Fixed value: the split that byte-level vocabularies are made for.
SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
         rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Characters of new pieces that are encoded as one text.
_GROUP = 20_000
#: Bytes that a piece takes in the store beside its text and ids.
_PIECE = 160

_JOINT = re.compile(f" (?=[^{WHITE}])")


def byte_chars() -> list[tuple[int, str]]:
    """Byte-level vocabularies write a byte as itself if it prints in Latin-1, others from 256 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(prints)]
    return [(b, chr(b)) for b in prints] + [(b, chr(256 + i)) for i, b in enumerate(others)]


class SegmentCoder:
    """``encode_all`` gives the ids (unsigned 32-bit) of each of some texts without special strings.

    ``lengths`` holds the bytes each id stands for, ``specials`` the strings that are
    one id wherever they stand. The store is emptied when it holds ``most`` pieces or
    ``most_bytes``.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[np.ndarray]], lengths: np.ndarray,
                 specials: dict[str, int], most: int = 600_000, most_bytes: int = 64_000_000):
        self.encode_all, self.lengths, self.most, self.most_bytes = encode_all, lengths, most, most_bytes
        self.specials = specials
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") \
            if specials else None
        self._empty()

    def _empty(self) -> None:
        """The first places are the special strings; pieces follow as they are met."""
        self.place: dict[str, int] = {}
        self.special_place = {text: i for i, text in enumerate(self.specials)}
        self.ids = np.array([*self.specials.values()], "<u4")
        self.begin, self.size = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)
        self.held = 0

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.begin), len(self.begin) + len(pieces))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.held += sum(map(len, pieces)) + _PIECE * len(pieces) + 4 * len(ids)

    def _learn(self, new: list[str]) -> None:
        """New pieces in one go: inner ones joined by their blanks in groups, heads by themselves.

        A head has no blank before it in the text, and is told apart by a leading one here.
        """
        groups, held = [], _GROUP
        for piece in new:
            if piece[:1] == " ":
                continue
            if held >= _GROUP:
                groups.append([])
                held = 0
            groups[-1].append(piece)
            held += len(piece)
        heads = [p for p in new if p[:1] == " "]
        found = self.encode_all(["".join([" " + p for p in g]) for g in groups] + [h[1:] for h in heads])
        names, sizes = [], []
        for group, ids in zip(groups, found):
            ends = np.cumsum([len(p.encode()) + 1 for p in group])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            names += group
            sizes.append(np.diff(cuts, prepend=0))
        sizes.append(np.array([len(ids) for ids in found[len(groups):]], np.int64))
        self._keep(names + heads, np.concatenate([*found, np.zeros(0, "<u4")]), np.concatenate(sizes))

    def _cut(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of a text with special strings or odd blanks, and which of them are special."""
        out = []
        for k, span in enumerate([text] if self.cut is None else self.cut.split(text)):
            if k % 2:
                out.append((span, True))
            elif span:
                head, *rest = _JOINT.split(span)
                out += [(" " + head, False), *((p, False) for p in rest)]
        return out

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in the store; new ones are learnt."""
        get = self.place.get
        found = np.array(list(map(get, pieces, repeat(-1))), np.int64)
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            wanted = [pieces[i] for i in missing]
            self._learn(list(dict.fromkeys(wanted)))
            found[missing] = list(map(get, wanted))
        return found

    def pack(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after the other, and where each begins, with the end of the last."""
        if len(self.place) > self.most or self.held > self.most_bytes:
            self._empty()
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        pieces = lists.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        first = np.zeros(len(pieces), bool)
        first[bounds[:-1]] = True
        coded = pieces.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        # A piece that is empty or begins with white space follows a blank that may not be cut at.
        odd = np.fromiter((p[:1] in WHITE for p in distinct), bool, len(distinct))[code]
        odd[first] = False
        apart = np.add.reduceat(odd, bounds[:-1]) > 0
        for special in self.specials:
            apart |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        heads = [" " + distinct[c] for c in code[bounds[:-1]].tolist()]
        used = np.zeros(len(distinct), bool)
        used[code[~first & ~np.repeat(apart, np.diff(bounds))]] = True
        by_code = np.full(len(distinct), -1)
        by_code[used] = self._places([p for p, u in zip(distinct, used.tolist()) if u])
        place = by_code[code]
        place[bounds[:-1]] = self._places(heads)
        if apart.any():
            parts, sizes = [], np.diff(bounds)
            cuts = np.flatnonzero(np.diff(apart, prepend=not apart[0]))
            for a, b in zip(cuts, [*cuts[1:], len(texts)]):
                if not apart[a]:
                    parts.append(place[bounds[a]:bounds[b]])
                    continue
                for k in range(a, b):
                    own = self._cut(texts[k].as_py())
                    known = iter(self._places([p for p, special in own if not special]).tolist())
                    parts.append(np.array([self.special_place[p] if special else next(known) for p, special in own], np.int64))
                    sizes[k] = len(own)
            place, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        size = self.size[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat((self.begin[place] - ends[:-1]).astype(np.int32), size)
        at += np.arange(ends[-1], dtype=np.int32)
        return self.ids[at], ends[bounds]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        ids, starts = self.pack(pa.array(texts, pa.string()))
        raw, cuts = ids.tobytes(), (4 * starts).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of ``values`` from each start to the next one, as an Arrow array of bytes."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
