"""Listings, lookups, filters and projections over a table of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factstore.functions.dates import parse_created_at
from factstore.functions.text import first_nonempty, variant_map
from factstore.schema import DEFAULT_USER_ID, ENTITY_KEYS, EXPORT_COLUMNS, LIST_LIMIT, PREVIEW_CHARS

# Payload members that are not metadata.
RESERVED_PAYLOAD_KEYS = ("data", "memory", "text", "user_id", "created_at", "embedding", "text_lemmatized")


#: Ids that are compared in the scan one by one.
MAX_PUSHED_IDS = 100


def by_time() -> tuple[Column, Column]:
    """The order of listings: creation time, unknown times first, then id."""
    return parse_created_at("created_at").asc_nulls_first(), F.col("id").asc_nulls_first()


def list_namespace(df: DataFrame, user_id: str = DEFAULT_USER_ID, limit: int | None = None) -> DataFrame:
    """All records of a namespace; with a limit the earliest ones."""
    rows = df.where(F.col("user_id") == user_id)
    return rows if limit is None else rows.orderBy(*by_time()).limit(limit)


def page(df: DataFrame, user_id: str | None = None, limit: int = LIST_LIMIT, page: int = 1) -> DataFrame:
    """One page of a listing, ordered by creation time and id.

    One namespace is a sort with offset and limit, so each task keeps only the
    leading rows. For the same page of every namespace, the rank filter below is
    applied by each task before anything is shuffled.
    """
    if limit < 1 or page < 1:
        raise ValueError("limit and page start at 1")
    first = (page - 1) * limit
    if user_id is not None:
        return df.where(F.col("user_id") == user_id).orderBy(*by_time()).offset(first).limit(limit)
    order = Window.partitionBy("user_id").orderBy(*by_time())
    return (df.withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= first + limit)
            .where(F.col("position") > first))


def flatten_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Stored points ``(id, payload JSON)`` as records.

    The text is the first member *present* of data, memory, text. Members that are
    not reserved become the metadata.
    """
    members = F.coalesce(variant_map(payload), F.create_map().cast("map<string,variant>"))

    def member(name, default=""):
        return F.when(F.map_contains_key(F.col("_m"), F.lit(name)),
                      F.try_variant_get(F.col("_m")[name], "$", "string")).otherwise(default)

    text = member("data", member("memory", member("text")))
    rest = F.to_json(F.map_filter(F.col("_m"), lambda k, v: ~k.isin(*RESERVED_PAYLOAD_KEYS)))
    entity = {k: F.try_variant_get(F.col("_m")[k], "$", "string") for k in ENTITY_KEYS[1:]}
    return (df.withColumn("_m", members)
            .select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
                    text.alias("memory"),
                    member("user_id").alias("user_id"),
                    *[c.alias(k) for k, c in entity.items()],
                    rest.alias("metadata"),
                    member("created_at").alias("created_at")))


def grep_records(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring over the whole record written as JSON."""
    if not query:
        return df
    blank = F.lit("")
    record = F.struct(
        *[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("id", "memory", "user_id", "created_at")],
        F.coalesce(F.try_parse_json(F.col("metadata")), F.parse_json(F.lit("{}"))).alias("metadata"))
    return df.where(F.contains(F.lower(F.to_json(record)), F.lower(F.lit(query))))


def of_entity(df: DataFrame, user_id: str = "") -> DataFrame:
    """Rows of one owner; the empty string means all."""
    return df.where(F.coalesce(F.col("user_id"), F.lit("")) == user_id) if user_id else df


def of_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``store`` whose ``id`` is among those of ``ids`` (one column ``id``).

    A few ids go into the scan as comparisons with single values, so that files and row groups
    are left out by their ranges and Bloom filters of ids; more are joined, which the optimizer
    does by broadcasting them if they are small.
    """
    few = ids.where(F.col("id").isNotNull()).distinct().limit(MAX_PUSHED_IDS + 1).collect()
    if len(few) > MAX_PUSHED_IDS:
        return store.join(ids.distinct(), "id", "left_semi")
    tests = [F.col("id") == F.lit(r["id"]) for r in few] or [F.lit(False)]
    while len(tests) > 1:  # a flat tree, however many there are
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2:]
    return store.where(tests[0])


def lookup(store: DataFrame, ids: DataFrame, column: str = "memory_id") -> DataFrame:
    """Requested ids with their records; ``found`` is false for an unknown id.

    The store is only filtered by the ids (``of_ids``); what is joined afterwards is no
    larger than the request.
    """
    wanted = ids.select(F.col(column).cast("string").alias("id")).where(F.col("id") != "").distinct()
    known = of_ids(store, wanted).withColumn("found", F.lit(True))
    return (wanted.join(known, "id", "left")
            .withColumn("found", F.coalesce("found", F.lit(False)))
            .withColumn("message", F.when(~F.col("found"), F.concat(
                F.lit("Failed to retrieve memory '"), F.col("id"), F.lit("'.")))))


def export_records(df: DataFrame, user_id: str | None = None) -> DataFrame:
    """The five export columns with their defaults."""
    legacy = [c for c in ("id", "memory_id") if c in df.columns]
    owner = F.col("user_id") if "user_id" in df.columns else F.lit(None).cast("string")

    def have(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return df.select(
        F.coalesce(first_nonempty(*legacy), F.lit("")).alias("id"),
        F.coalesce(have("memory"), F.lit("")).alias("memory"),
        F.coalesce(have("metadata"), F.lit("{}")).alias("metadata"),
        F.coalesce(have("created_at"), F.lit("")).alias("created_at"),
        F.coalesce(owner, F.lit(user_id)).alias("user_id"),
    ).select(*EXPORT_COLUMNS)


def with_scores(df: DataFrame, include: bool = True) -> DataFrame:
    if not include:
        return df.drop("score")
    return df if "score" in df.columns else df.withColumn("score", F.lit(None).cast("double"))


def score_floor(df: DataFrame, min_score: float | None) -> DataFrame:
    """Search floor: off for null and 0; a hit without a score is kept."""
    if not min_score:
        return df
    return df.where(F.col("score").isNull() | (F.col("score") >= min_score))


def older_than(days: float, as_of: float) -> Column:
    """Strictly older than the cutoff; a missing or unreadable date never is."""
    return F.coalesce(parse_created_at("created_at") < F.lit(float(as_of) - days * 86400.0), F.lit(False))


def below_retention(min_score: float | None) -> Column:
    """Prune floor: with a floor set, 0 included, only lower scores may go."""
    if min_score is None:
        return F.lit(True)
    return F.col("score").isNotNull() & (F.col("score") < min_score)


def preview(c: str = "memory") -> Column:
    return F.substring(F.coalesce(F.col(c), F.lit("")), 1, PREVIEW_CHARS)


def listing_cards(df: DataFrame) -> DataFrame:
    """What the listing page shows for each record."""
    texts = [c for c in ("memory", "memory_text", "text") if c in df.columns]
    ids = [c for c in ("id", "memory_id") if c in df.columns]
    score = F.col("score") if "score" in df.columns else F.lit(None).cast("double")
    text = F.coalesce(first_nonempty(*texts), F.lit(""))
    return df.select(
        F.replace(text, F.lit("<"), F.lit("&lt;")).alias("card_text"),
        F.coalesce(first_nonempty("user_id"), F.lit("-")).alias("owner"),
        F.substring(F.coalesce(first_nonempty(*ids), F.lit("")), 1, 12).alias("short_id"),
        F.coalesce(first_nonempty("created_at"), F.lit("-")).alias("created"),
        F.when(score.isNull(), F.lit("")).otherwise(F.format_string("%.3f", score.cast("double"))).alias("score_text"))


def list_entities(df: DataFrame) -> DataFrame:
    """Distinct non-empty values of the four entity keys, as one sorted set."""
    keys = [F.col(k).cast("string") for k in ENTITY_KEYS if k in df.columns]
    return (df.select(F.explode(F.array(*keys)).alias("entity"))
            .where(F.col("entity") != "")
            .distinct()
            .orderBy("entity"))


def listing_stats(df: DataFrame) -> DataFrame:
    """Record count and number of owners.

    Counting per owner first means the distinct count works on one row per owner.
    """
    return (df.groupBy(F.coalesce("user_id", F.lit("")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("memories"),
                 F.count_if(F.col("owner") != "").alias("entities")))
