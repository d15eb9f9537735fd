"""Text, JSON and CSV expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's str.isspace accepts; all lie below U+3001.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Repeating a long expression makes the plan grow with every use, and inside a
    fold it would be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(_col(value)), body), 1)


def py_strip(c) -> Column:
    """Strip Unicode whitespace from both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def first_nonempty(*cols) -> Column:
    """First argument that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def dedup_key(c) -> Column:
    """The form under which two texts count as the same memory."""
    return F.lower(py_strip(c))


def key_digest(user_id, c) -> Column:
    """SHA-256 of namespace and dedup key: 32 bytes to shuffle instead of a whole text.

    The namespace's length goes in front, so that no two pairs run together. The
    digest is never null, which spares the joins a filter that would compute it again.
    """
    owner = F.coalesce(_col(user_id), F.lit(""))
    keyed = F.concat(F.length(owner).cast("string"), F.lit(":"), owner, F.coalesce(dedup_key(c), F.lit("")))
    return F.coalesce(F.unhex(F.sha2(keyed, 256)), F.lit(b""))


def record_id(*parts) -> Column:
    """Identifier derived from what identifies the record, in UUID form.

    The same request gives the same id when a task is retried or a micro-batch
    is replayed, which a random UUID would not.
    """
    joined = F.to_json(F.struct(*[_col(p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)]),
                       {"ignoreNullFields": "false"})
    digest = F.sha2(joined, 256)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)


def metadata_cell(c) -> Column:
    """Metadata as a CSV cell: empty metadata gives an empty cell."""
    stripped = py_strip(c)
    return F.when(stripped.isNull() | stripped.isin("", "{}", "null"), F.lit("")).otherwise(_col(c))


def csv_field(c) -> Column:
    """Minimal quoting: only fields holding a comma, a quote or a line break."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)


def csv_line(*cols) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in cols])


def quoted_csv_line(*cols) -> Column:
    """Every field quoted, as the browser page writes it."""
    texts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.concat_ws(",", *[
        F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')) for t in texts])


def strict_json(c) -> Column:
    """Parse text that must be one JSON value and nothing else; null otherwise.

    ``try_parse_json`` stops after the first value and ignores what follows. Text
    that is valid both as the only element of a list and as the only member of an
    object cannot have closed either early, so nothing can follow it.
    """
    text = _col(c)
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return let(listed, lambda items: F.when((F.size(items) == 1) & alone, F.try_element_at(items, F.lit(1))))


def variant_map(json_text) -> Column:
    """A JSON object as map<string,variant>; null when it is not an object."""
    return F.try_variant_get(F.try_parse_json(_col(json_text)), "$", "map<string,variant>")


def json_put(json_text, key: str, value) -> Column:
    """Set one string member of a JSON object, keeping the types of the others."""
    present = F.coalesce(variant_map(json_text), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(present, lambda k, v: k != F.lit(key))
    member = F.create_map(F.lit(key), _col(value).cast("variant"))
    return F.to_json(F.map_concat(others, member))


def relative_path(path, root: str) -> Column:
    """Path below ``root`` (both fully qualified)."""
    base = root.rstrip("/") + "/"
    p = _col(path)
    return F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(p)


def universal_newlines(c) -> Column:
    """CRLF and CR become LF, as text-mode reading does."""
    return F.regexp_replace(_col(c), "\\r\\n?", "\n")


# Older model names and the canonical id they stand for.
MODEL_ALIASES = {
    "nomic-embed-text": "nomic-ai/nomic-embed-text-v1.5",
    "nomic-embed-text:v1.5": "nomic-ai/nomic-embed-text-v1.5",
    "nomic-embed-text-v1.5": "nomic-ai/nomic-embed-text-v1.5",
}


def canonical_model(c) -> Column:
    """Canonical model id for a name; an unknown name passes through stripped."""
    name = py_strip(c)
    known = F.create_map(*[F.lit(x) for pair in MODEL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)
