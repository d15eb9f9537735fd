"""Import payloads: JSON arrays, export envelopes, JSON Lines, CSV and TSV.

Items come out as ``(pos, item_type, text_type, memory, metadata)``. JSON Lines is
the form for large imports because Spark can split it; an array or an envelope is
one JSON value and is therefore read as one row.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factstore.functions.text import _col, is_blank, let, py_strip, strict_json
from factstore.session import shared_folder
from factstore.sources import ranges
from factstore.sources.files import children, is_directory

ITEM_COLUMNS = ("pos", "item_type", "text_type", "memory", "metadata")
#: A JSON file up to this size is read as one value.
WHOLE_BYTES = 32_000_000
#: The start of an envelope up to its list, and the end of a list with what may follow it.
ENVELOPE_START = "^" + ranges.ENVELOPE_HEAD.pattern
ARRAY_END = r"\s*\](?:\s*,\s*%s\s*:\s*%s)*\s*\}?\s*$" % (ranges._STRING, ranges._SCALAR)
FORMATS = ("auto", "json", "jsonl", "csv", "tsv")


def value_type(v) -> Column:
    """Type name of a JSON value: dict, list, str, bool, int, float or NoneType."""
    def named(name):
        whole = name.startswith("BIGINT") | name.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
        return (F.when(name.isNull() | (name == "VOID"), "NoneType")
                .when(name.startswith("OBJECT"), "dict")
                .when(name.startswith("ARRAY"), "list")
                .when(name == "STRING", "str")
                .when(name == "BOOLEAN", "bool")
                .when(whole, "int")
                .otherwise("float"))

    return let(F.schema_of_variant(_col(v)), named)


def _truthy_text(value: Column) -> Column:
    """A member as (kind, text), or null when it counts as absent."""
    def judged(typed):
        kind, text = typed["kind"], typed["text"]
        absent = (text.isNull() | (text == "")
                  | ((kind == "bool") & (text == "false"))
                  | (kind.isin("int", "float") & (text.try_cast("double") == 0))
                  | (kind.isin("list", "dict") & text.isin("[]", "{}")))
        shown = F.when(kind == "bool", F.lit("True")).otherwise(text)
        return F.when(~absent, F.struct(kind.alias("kind"), shown.alias("text")))

    return let(F.struct(value_type(value).alias("kind"), value.cast("string").alias("text")), judged)


def _parsed(item: Column) -> Column:
    """Type, text and metadata of one item; the text only of an object."""
    def fields(kind):
        chosen = F.coalesce(*[_truthy_text(F.try_variant_get(item, f"$.{key}", "variant"))
                              for key in ("memory", "text", "content")])
        metadata = F.try_variant_get(item, "$.metadata", "variant")
        as_json = F.when((kind == "dict") & (F.schema_of_variant(metadata) != "VOID"), F.to_json(metadata))
        return let(F.when(kind == "dict", chosen), lambda text: F.struct(
            kind.alias("item_type"), text["kind"].alias("text_type"), text["text"].alias("memory"),
            as_json.alias("metadata")))

    return let(value_type(item), fields)


def parse_items(df: DataFrame, item: str = "item") -> DataFrame:
    """Turn a VARIANT item into typed columns.

    The text is the first of memory, text, content that is neither missing nor empty.
    The columns come out of a generator, through which no filter is moved: the item is
    parsed once even where the rows are filtered by several of the columns.
    """
    kept = [c for c in df.columns if c != item]
    return df.select(*kept, F.inline(F.array(let(item, _parsed))))


def read_json_array(df: DataFrame, column: str = "data") -> DataFrame:
    """One row per element of the JSON arrays in ``column``, with position and type."""
    kept = [c for c in df.columns if c != column]
    items = F.try_variant_get(strict_json(column), "$", "array<variant>")
    # Outer, so that no filter on the array's size parses the text a second time.
    elements = df.select(*kept, F.posexplode_outer(items).alias("pos", "item")).where(F.col("pos").isNotNull())
    return parse_items(elements.withColumn("pos", F.col("pos").cast("bigint")))


def _wrap_strings(items: DataFrame) -> DataFrame:
    """Bare strings are texts in a payload file: ``"x"`` is read as ``{"memory": "x"}``."""
    bare = F.try_variant_get(F.col("item"), "$", "string")
    wrapped = F.parse_json(F.to_json(F.struct(bare.alias("memory"))))
    return items.withColumn("item", F.when(value_type("item") == "str", wrapped).otherwise(F.col("item")))


def _position() -> Column:
    """Where a row of a file source stands: file, place of its block, row in reading order, item.

    The order is that of the file names and of the rows in them, however the files are
    split among tasks.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"), F.lit(0).cast("bigint").alias("item")).alias("pos")


def _texts(spark: SparkSession, path, chosen: Column | None = None) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    files = files if chosen is None else files.where(chosen)
    return files.select(_position(), py_strip("value").alias("text"))


def _read_large(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Items of large arrays and envelopes, read by ranges, and the files that are something else.

    A record is a stretch of an array's text: what opens the array or the comma before it, and
    elements up to one that is an object. The texts before and behind the elements of a file must
    be JSON by themselves, and each record's elements too; else the file is no JSON.
    """
    found, starts = ranges.records(spark, path, ranges.JsonScan(), WHOLE_BYTES)
    place = shared_folder(spark, "json-records")
    found.write.parquet(f"{place}/records")
    starts.where("block = 0").select("file", "base").write.parquet(f"{place}/files")
    found, files = (spark.read.parquet(f"{place}/{n}") for n in ("records", "files"))
    edge = F.when((F.col("block") == 0) & (F.col("seq") == 0), F.struct(F.lit(True).alias("first"))).isNotNull()
    head = F.regexp_extract("text", ENVELOPE_START, 0)
    head = F.when(head != "", head).otherwise(F.regexp_extract("text", r"^\s*\[", 0))
    rest = F.when(edge, F.substr("text", F.length(head) + 1)).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    tail = F.when(~F.col("closed"), F.regexp_extract(rest, ARRAY_END, 0)).otherwise("")
    cut = found.select("*", edge.alias("edge"), head.alias("head"), tail.alias("tail"), rest.alias("rest"))
    body = F.expr("substr(rest, 1, length(rest) - length(tail))")
    # Only the first record may do without a comma, and the last one if it holds no element.
    empty = F.trim(F.regexp_replace(body, r"\s", "")) == ""
    follows = F.col("edge") | F.col("text").rlike(r"^\s*,") | (~F.col("closed") & empty)
    odd = ~follows | ((~F.col("edge")) & F.col("text").rlike(r"^\s*,") & empty)
    cut = cut.select("file", "block", "seq", "closed", "edge", "head", "tail", odd.alias("odd"), empty.alias("empty"),
                     strict_json(F.concat(F.lit("["), body, F.lit("]"))).alias("data"))
    judged = (cut.groupBy("file").agg(
        F.bool_or(F.col("odd") | F.col("data").isNull()).alias("odd"), F.count_if(~F.col("closed")).alias("open"),
        F.max(F.when(F.col("edge"), F.col("head"))).alias("head"), F.max("tail").alias("tail")))
    sound = ~F.col("odd") & (F.col("open") == 1) & (F.col("tail") != "") & strict_json(F.concat("head", "tail")).isNotNull()
    states = files.join(judged, "file", "left").select("file", F.coalesce(sound, F.lit(False)).alias("sound"))
    others = [unquote(r["file"]) for r in states.where(~F.col("sound")).select("file").collect()]
    elements = cut.join(states.where("sound").select("file"), "file", "left_semi").where(~F.col("empty"))
    items = elements.select("file", "block", "seq", F.posexplode_outer(F.try_variant_get("data", "$", "array<variant>")).alias("_at", "item"))
    return items.where(F.col("_at").isNotNull()).select(
        F.struct("file", "block", F.col("seq").alias("row"), F.col("_at").cast("bigint").alias("item")).alias("pos"), "item"), others


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    if spark.read.format("binaryFile").load(path).where(F.col("length") > WHOLE_BYTES).limit(1).isEmpty():
        return _read_whole(_texts(spark, path))
    small = _texts(spark, path, F.col("_metadata.file_size") <= WHOLE_BYTES)
    items, others = _read_large(spark, path)
    found = _read_whole(small).unionByName(items)
    return found.unionByName(_read_whole(_texts(spark, others))) if others else found


def _read_whole(texts: DataFrame) -> DataFrame:
    """Items of files whose text is one value each."""
    parsed = texts.select("pos", strict_json("text").alias("data"))
    as_list = F.try_variant_get(F.col("data"), "$", "array<variant>")
    enveloped = F.try_variant_get(F.col("data"), "$.memories", "array<variant>")
    items = F.coalesce(as_list, enveloped, F.array("data"))
    return parsed.select("pos", items.alias("items")).select(
        "pos", F.posexplode_outer("items").alias("_at", "item")).where(F.col("_at").isNotNull()).select(
        F.col("pos").withField("item", F.col("_at").cast("bigint")).alias("pos"), "item")


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(_position(), py_strip("value").alias("line"))
    parsed = lines.where(F.col("line") != "").withColumn("item", strict_json("line"))
    # A line that is no JSON is kept as an item that fails validation.
    return parsed.select("pos", F.coalesce("item", F.parse_json(F.lit("null"))).alias("item"))


def _header(spark: SparkSession, path: str, separator: str) -> list[str]:
    """Column names: the first line of the first file that has one."""
    files = [path]
    if is_directory(spark, path):
        files = [f"{path}/{n}" for n in children(spark, path) if n[0] not in "._"]
    lines = (spark.read.text(f).first() for f in files)
    line = next((r["value"] for r in lines if r is not None), "")
    return next(csv.reader([line], delimiter=separator), [])


def _read_table(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Rows of CSV files of which the first, or each, starts with the header.

    Records may hold line ends; large files are read by ranges all the same.
    """
    header = _header(spark, path, separator)
    schema = ", ".join(f"_c{i} string" for i in range(max(1, len(header))))
    found, _ = ranges.records(spark, path, ranges.CsvScan(separator))
    # Three reads of the records follow, and each would cut the files anew.
    place = shared_folder(spark, "csv-records")
    found.write.parquet(place)
    found = spark.read.parquet(place)
    # The line end behind a record is not part of it, nor is a blank line a record.
    record = F.regexp_replace("text", "\r?\n?$", "")
    found = found.select("file", "block", "seq", record.alias("record")).where(F.col("record") != "")
    cells = F.from_csv("record", schema, {"sep": separator, "escape": '"'})
    pos = F.struct("file", "block", F.col("seq").alias("row"), F.lit(0).cast("bigint").alias("item"))
    last = f"_c{max(1, len(header)) - 1}"
    rows = found.select(pos.alias("pos"), cells.alias("_c")).select("pos", "_c.*").withColumn(last, F.nullif(last, F.lit("")))
    # A header stands first in its file, before which there may be blank lines only.
    first = rows.groupBy(F.col("pos.file").alias("file")).agg(F.min("pos").alias("first"))
    is_header = reduce(Column.__and__, [F.col(f"_c{i}").eqNullSafe(F.lit(n or None)) for i, n in enumerate(header)], F.lit(True))
    headed = rows.where(is_header).join(first, F.col("pos") == F.col("first")).select(F.col("pos").alias("header"))
    rows = rows.join(headed, F.col("pos") == F.col("header"), "left_anti")
    names = {n.strip(): f"_c{i}" for i, n in enumerate(header)}
    if "memory" not in names:
        raise ValueError("CSV has no memory column")
    meta = F.col(f"`{names['metadata']}`") if "metadata" in names else F.lit(None).cast("string")
    as_object = F.try_variant_get(F.try_parse_json(meta), "$", "map<string,variant>")
    return rows.select(
        "pos", F.lit("dict").alias("item_type"), F.lit("str").alias("text_type"),
        F.col(f"`{names['memory']}`").alias("memory"),
        F.when(as_object.isNotNull(), meta).alias("metadata"))


def _table_kind(head: Column) -> Column:
    return (F.when(head.contains("memory"), F.when(head.contains("\t"), "tsv").otherwise("csv"))
            .otherwise("unknown"))


def detect_format(spark: SparkSession, path: str) -> str:
    """Format of a payload by its content. Files of different formats need ``fmt``.

    Files are judged by their lines, so that JSON Lines stays splittable; only files that
    start like a JSON value and have lines that are none are read as a whole.
    """
    line = spark.read.text(path).select(_position(), py_strip("value").alias("line")).where(F.col("line") != "")
    files = line.groupBy("pos.file").agg(
        F.count(F.lit(1)).alias("lines"), F.bool_and(strict_json("line").isNotNull()).alias("all_json"),
        F.min_by("line", "pos").alias("head"))
    head = F.col("head")
    kind = (F.when(F.col("all_json"), F.when(F.col("lines") == 1, "json").otherwise("jsonl"))
            .when(head.startswith("[") | head.startswith("{"), "whole")
            .otherwise(_table_kind(head)))
    first = {r["kind"]: r["first"] for r in files.groupBy(kind.alias("kind")).agg(F.min("file").alias("first")).collect()}
    # The parts of a CSV document after its first have no header.
    headed = [first[k] for k in ("csv", "tsv") if k in first]
    kinds = [k for k in first if k != "unknown" or not headed or min(headed) > first[k]]
    if "whole" in kinds:
        whole = (F.when(is_blank("text"), "empty").when(strict_json("text").isNotNull(), "json")
                 .otherwise(_table_kind(F.split("text", "\n")[0])))
        found = [r["kind"] for r in _texts(spark, path).select(whole.alias("kind")).distinct().collect()]
        kinds = [k for k in kinds if k in ("json", "jsonl")] + [k for k in found if k != "unknown" or "jsonl" not in kinds]
        kinds = list(dict.fromkeys(kinds))
    if kinds == ["empty"] or not kinds:
        raise ValueError("Nothing to import")
    if "unknown" in kinds:
        raise ValueError("Not valid JSON, JSON Lines, or CSV")
    found = [k for k in kinds if k != "empty"]
    if len(found) > 1:
        raise ValueError(f"files of several formats ({', '.join(sorted(found))}); pass fmt")
    return found[0]


def read_import(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Items of a payload file or directory, ready for validation."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {', '.join(FORMATS)}")
    if fmt == "auto":
        fmt = detect_format(spark, path)
    if fmt in ("csv", "tsv"):
        return _read_table(spark, path, "\t" if fmt == "tsv" else ",")
    items = _read_json(spark, path) if fmt == "json" else _read_lines(spark, path)
    return parse_items(_wrap_strings(items)).select(*ITEM_COLUMNS)
