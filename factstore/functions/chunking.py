"""Paragraph-first packing of a text into pieces of bounded length.

The packing is a fold over paragraphs, lines and words, written with Spark's own
``aggregate`` so that no row leaves the JVM. A text at or under the limit skips it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factstore.functions.text import _col, json_put, let

_NO_CHUNKS = "cast(array() as array<string>)"
# Up to this room the regular expression engine needs only a shallow stack.
_PATTERN_ROOM = 8192
_BLOCK = 1024


def _state(chunks: Column, pending: Column, size: Column) -> Column:
    """Finished chunks, the text being filled, and that text's length."""
    return F.struct(chunks.alias("chunks"), pending.alias("pending"), size.alias("size"))


def _start() -> Column:
    return _state(F.expr(_NO_CHUNKS), F.lit(""), F.lit(0))


def _push(chunks: Column, piece: Column) -> Column:
    """Add a piece unless it is empty."""
    return F.when(piece != "", F.concat(chunks, F.array(piece))).otherwise(chunks)


def _glue(pending: Column, separator: str, piece: Column) -> Column:
    return F.when(pending == "", piece).otherwise(F.concat(pending, F.lit(separator), piece))


def _glued_size(size: Column, separator: str, piece: Column) -> Column:
    return F.when(size == 0, F.length(piece)).otherwise(size + len(separator) + F.length(piece))


def _after(chunks: Column, state: Column) -> Column:
    """A state that follows already finished chunks."""
    return let(state, lambda s: _state(F.concat(chunks, s["chunks"]), s["pending"], s["size"]))


def _fold(items: Column, start: Column, step) -> Column:
    """Fold in blocks, each starting with no finished chunks.

    Every step of ``aggregate`` copies its state. With one long list of chunks in it
    the time would grow with the square of the text's length.
    """
    def add_block(acc, block):
        fresh = _state(F.expr(_NO_CHUNKS), acc["pending"], acc["size"])
        return _after(acc["chunks"], F.aggregate(block, fresh, step))

    def over(every):
        last = F.floor((F.size(every) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last),
                             lambda i: F.slice(every, i * _BLOCK + 1, F.lit(_BLOCK)))
        return F.aggregate(blocks, start, add_block)

    return let(items, over)


def split_words(line: Column, room: Column) -> Column:
    """Pack the words of one over-long line; a word over the limit is cut by characters.

    One pass of a pattern with three cases, in this order: the rest of a word that was
    cut, the longest run of whole words that fits, the first cut of a word too long.
    """
    room_text, less = room.cast("string"), (room - 1).cast("string")
    pattern = F.concat(
        F.lit("(?s)(?<=[^ ])[^ ]{1,"), room_text, F.lit("}+"),
        F.lit("|[^ ].{0,"), less, F.lit("}(?= |\\z)"),
        F.lit("|[^ ]{"), room_text, F.lit("}+"))
    return F.regexp_extract_all(line, pattern, F.lit(0))


def fold_words(line: Column, room: Column) -> Column:
    """The same packing word by word, for a room beyond what the pattern is used for."""
    def add_word(acc, word):
        chunks, pending = acc["chunks"], acc["pending"]
        huge = F.length(word) > room
        full = (acc["size"] + F.length(word) + 1 > room) & (pending != "")
        # Possessive repetition: no backtracking, so no deep recursion on long words.
        cuts = F.regexp_extract_all(word, F.concat(F.lit("(?s).{1,"), room.cast("string"), F.lit("}+")), F.lit(0))
        return _state(
            F.when(huge, F.concat(_push(chunks, pending), cuts))
             .when(full, F.concat(chunks, F.array(pending)))
             .otherwise(chunks),
            F.when(huge, F.lit("")).when(full, word).otherwise(_glue(pending, " ", word)),
            F.when(huge, F.lit(0)).when(full, F.length(word)).otherwise(_glued_size(acc["size"], " ", word)))

    return let(_fold(F.split(line, " "), _start(), add_word), lambda end: _push(end["chunks"], end["pending"]))


def _pack_lines(paragraph: Column, pending_now: Column, size_now: Column, room: Column, compat: bool, words) -> Column:
    def add_line(acc, line):
        chunks, pending = acc["chunks"], acc["pending"]
        huge = F.length(line) > room
        full = acc["size"] + F.length(line) + 1 > room
        before = chunks if compat else _push(chunks, pending)
        return _state(
            F.when(huge, F.concat(before, words(line, room)))
             .when(full, _push(chunks, pending))
             .otherwise(chunks),
            F.when(huge, pending if compat else F.lit("")).when(full, line).otherwise(_glue(pending, "\n", line)),
            F.when(huge, acc["size"] if compat else F.lit(0)).when(full, F.length(line))
             .otherwise(_glued_size(acc["size"], "\n", line)))

    return _fold(F.split(paragraph, "\n"), _state(F.expr(_NO_CHUNKS), pending_now, size_now), add_line)


def pack(text: Column, room: Column, compat: bool = True, words=split_words) -> Column:
    """Pieces of ``text``, each at most ``room`` characters long.

    With ``compat`` the text pending when an over-long paragraph begins is emitted
    and also kept, so it appears a second time. Without it, pending text is emitted
    once and always ahead of what follows it.
    """
    def add_paragraph(acc, paragraph):
        chunks, pending, size = acc["chunks"], acc["pending"], acc["size"]
        fits = size + F.length(paragraph) + 2 <= room
        flushed = _push(chunks, pending)
        carried = (pending, size) if compat else (F.lit(""), F.lit(0))
        return (F.when(fits, _state(chunks, _glue(pending, "\n\n", paragraph), _glued_size(size, "\n\n", paragraph)))
                .when(F.length(paragraph) <= room, _state(flushed, paragraph, F.length(paragraph)))
                .otherwise(_after(flushed, _pack_lines(paragraph, *carried, room, compat, words))))

    return let(_fold(F.split(text, "\n\n"), _start(), add_paragraph), lambda end: _push(end["chunks"], end["pending"]))


def body_room(max_chars: int, header=None) -> Column:
    """Characters left for the body once the header and its blank line are taken off."""
    if header is None:
        return F.lit(max_chars)
    return let(F.coalesce(_col(header), F.lit("")),
               lambda head: max_chars - F.when(head == "", F.lit(0)).otherwise(F.length(head) + 2))


def _body(text: Column, room: Column, compat: bool, max_chars: int) -> Column:
    words = split_words if max_chars <= _PATTERN_ROOM else fold_words
    return F.when(F.length(text) <= room, F.array(text)).when(room > 0, pack(text, room, compat, words))


def chunk_text(text, max_chars: int, header=None, compat: bool = True) -> Column:
    """``array<string>`` of chunks; null when the header leaves no room for the body."""
    text = _col(text)
    if header is None:
        return _body(text, F.lit(max_chars), compat, max_chars)

    def under(head):
        return let(max_chars - F.length(head) - 2, lambda room: F.transform(
            _body(text, room, compat, max_chars), lambda piece: F.concat(head, F.lit("\n\n"), piece)))

    return let(F.coalesce(_col(header), F.lit("")), lambda head: F.when(
        head == "", _body(text, F.lit(max_chars), compat, max_chars)).otherwise(under(head)))


def header_server(metadata) -> Column:
    """``[Document: f] [Source: s]``, each part only when the metadata has it."""
    def parts(data):
        def part(key, label):
            value = F.try_variant_get(data, f"$.{key}", "string")
            return F.when(value != "", F.concat(F.lit(f"[{label}: "), value, F.lit("]")))

        return F.concat_ws(" ", part("file", "Document"), part("source", "Source"))

    return let(F.try_parse_json(_col(metadata)), parts)


def header_import(file) -> Column:
    """Header of the document importer: always both parts, no space between them."""
    return F.concat(F.lit("[Document: "), _col(file), F.lit("][Source: docs_import]"))


def tag_chunk(metadata, pos, total, tagged=None) -> Column:
    """Metadata with ``chunk: "i/n"`` added where ``tagged`` holds (by default: several chunks)."""
    tag = F.concat_ws("/", (_col(pos) + 1).cast("string"), _col(total).cast("string"))
    wanted = _col(total) > 1 if tagged is None else tagged
    return F.when(wanted, json_put(metadata, "chunk", tag)).otherwise(_col(metadata))
