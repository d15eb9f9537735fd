"""Row validation: each rule fills ``error_code``, ``message`` and ``fix``; none throws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factstore.functions.chunking import body_room, header_server
from factstore.functions.text import is_blank, py_strip, strict_json
from factstore.schema import CHUNK_CHARS, DEFAULT_USER_ID, MIN_DOCUMENT_CHARS

# The message texts below, which callers compare; the hints are free.

ERROR_COLUMNS = ("error_code", "message", "fix")


def _checked(df: DataFrame, rules: list[tuple[Column, str, Column | str, str | None]]) -> DataFrame:
    """Attach the first rule that applies to each row."""
    def pick(i):
        chosen = F.lit(None).cast("string")
        for rule in reversed(rules):
            value = rule[i] if isinstance(rule[i], Column) else F.lit(rule[i]).cast("string")
            chosen = F.when(rule[0], value).otherwise(chosen)
        return chosen

    return df.withColumns({name: pick(i + 1) for i, name in enumerate(ERROR_COLUMNS)})


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("error_code").isNull()).drop(*ERROR_COLUMNS)


def rejects(df: DataFrame) -> DataFrame:
    """The per-row failure list, for a sink of its own."""
    return df.where(F.col("error_code").isNotNull())


def with_namespace(df: DataFrame, default: str = DEFAULT_USER_ID) -> DataFrame:
    """Fill in the default namespace where the argument is absent."""
    current = F.col("user_id") if "user_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("user_id", F.coalesce(current, F.lit(default)))


def validate_add(df: DataFrame, mode: str = "fact", max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Check add requests. ``fact`` bounds the stripped length; ``verbatim`` does not."""
    if mode not in ("fact", "verbatim"):
        raise ValueError("mode must be 'fact' or 'verbatim'")
    content = F.col("content")
    fact = mode == "fact"
    rules = [
        (content.isNull(), "content_required", "content is required.",
         "Send a content value with the text to keep."),
        (is_blank(content), "empty_content", "Cannot save empty content.",
         "Send at least one visible character."),
    ]
    if fact:
        rules.append((
            F.length(py_strip(content)) > max_chars, "too_long",
            F.concat(F.lit("Content exceeds the verbatim chunk size: "), F.length(content).cast("string"),
                     F.lit(f" chars (limit {max_chars}).")),
            "Send it in verbatim mode, which cuts long texts, or shorten it."))
    elif "metadata" in df.columns:
        room = body_room(max_chars, header_server("metadata"))
        rules.append((
            (F.length(content) > max_chars) & (room <= 0), "header_too_long",
            "The context header leaves no room for text in a chunk.",
            "Shorten metadata.file or metadata.source, or raise the chunk size."))
    return _checked(df, rules)


def validate_queries(df: DataFrame) -> DataFrame:
    return _checked(df, [(is_blank("query"), "empty_query", "Search query cannot be empty.", None)])


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def validate_ids(df: DataFrame, column: str = "memory_id") -> DataFrame:
    """Requests that name a record or, with ``column="user_id"``, an entity."""
    return _checked(df, [(_missing(column), "id_required", f"{column} is required.", None)])


def validate_updates(df: DataFrame) -> DataFrame:
    return _checked(df, [
        (_missing("memory_id"), "id_required", "memory_id is required.", None),
        (is_blank("content"), "empty_content", "New content cannot be empty.", None),
    ])


def validate_batches(df: DataFrame) -> DataFrame:
    """Import batches ``(user_id, data)``: a namespace and a non-empty JSON array."""
    parsed = strict_json("data")
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return _checked(df, [
        (is_blank("user_id"), "user_required", "user_id is required", None),
        (is_blank("data"), "data_required", "data is required (JSON string of memory array).", None),
        (parsed.isNull(), "invalid_json", "data is not valid JSON.",
         "Provide a JSON array of exported memories."),
        (items.isNull(), "not_an_array", "data must be a JSON array of memory objects.", None),
        (F.size(items) == 0, "empty_batch", "memories must be a non-empty array", None),
    ])


def validate_import(df: DataFrame) -> DataFrame:
    """Check parsed import items (``item_type``, ``memory``, ``text_type``)."""
    return _checked(df, [
        (F.col("item_type") != "dict", "not_an_object",
         F.concat(F.lit("Non-dict item skipped: "), F.col("item_type")), None),
        (F.col("text_type").isin("list", "dict"), "text_not_scalar", "Memory text is not a string, skipped", None),
        (is_blank("memory"), "empty_text", "Empty memory text, skipped", None),
    ])


def skip_short(df: DataFrame, min_chars: int = MIN_DOCUMENT_CHARS, column: str = "text") -> DataFrame:
    """Keep documents whose stripped text has at least ``min_chars`` characters."""
    return df.where(F.length(py_strip(column)) >= min_chars)


def check_export_format(fmt: str) -> None:
    if fmt not in ("json", "csv"):
        raise ValueError(f"Invalid format '{fmt}'. Use 'json' or 'csv'.")
