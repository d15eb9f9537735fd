"""Record tables derived from the given tables; the SQL twins are in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factstore.sources.files import read_wide

# 2025-01-01T00:00:00Z, the fixed "now" of the pruning queries.
AS_OF = 1735689600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores for work that is heavy per row."""
    return read_wide(spark, f"{sf_dir}/documents.parquet")


def _created_at():
    """Creation times in every spelling the parser knows, and some it does not."""
    return F.expr("""
        CASE doc_id % 12
          WHEN 0 THEN concat(d, 'T', t)
          WHEN 1 THEN concat(d, 'T', t, 'Z')
          WHEN 2 THEN concat(d, 'T', t, '.250000+05:30')
          WHEN 3 THEN d
          WHEN 4 THEN cast(1546300800 + days * 86400 + secs AS string)
          WHEN 5 THEN concat(cast(1546300800 + days * 86400 + secs AS string), '.5')
          WHEN 6 THEN 'not a date'
          WHEN 7 THEN null
          WHEN 8 THEN concat(d, ' ', t)
          WHEN 9 THEN concat('  ', d, 'T', substr(t, 1, 5), ' ')
          WHEN 10 THEN replace(d, '-', '')
          ELSE concat(d, 'T', replace(t, ':', ''), '-0800')
        END""")


def memories(spark: SparkSession, sf_dir: str, scored: bool = False, wide: bool = False) -> DataFrame:
    """Documents as records; with ``scored`` the label's quality is the score."""
    docs = documents(spark, sf_dir) if wide else table(spark, sf_dir, "documents")
    if scored:
        labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
        docs = docs.join(labels, "doc_id", "left")
    clock = (docs.withColumn("days", F.expr("doc_id * 37 % 2500")).withColumn("secs", F.expr("doc_id * 7919 % 86400"))
             .withColumn("d", F.expr("cast(date_add(date'2019-01-01', cast(days AS int)) AS string)"))
             .withColumn("t", F.expr("""concat_ws(':', lpad(secs div 3600, 2, '0'),
                                        lpad(secs % 3600 div 60, 2, '0'), lpad(secs % 60, 2, '0'))""")))
    extra = ["score"] if scored else []
    return clock.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("memory"),
        F.col("source").alias("user_id"),
        F.to_json(F.struct("lang", "n_chars")).alias("metadata"),
        _created_at().alias("created_at"), *extra)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("user_id"), "embedding")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per namespace: the mean of its vectors."""
    parts = vectors(spark, sf_dir).select("user_id", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("user_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One row per dimension and namespace is left to gather.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return (means.groupBy("user_id").agg(ordered.alias("embedding"))
            .select(F.col("user_id").alias("query_id"), "user_id", "embedding"))


def first_vector(spark: SparkSession, sf_dir: str, user_id: str) -> list[float]:
    """The query vector of the single searches: the namespace's first record."""
    return (vectors(spark, sf_dir).where(F.col("user_id") == user_id)
            .agg(F.min_by("embedding", "id").alias("v")).first()["v"])


def document_files(spark: SparkSession, sf_dir: str, paragraphs: bool = False) -> DataFrame:
    """Documents as files; with ``paragraphs`` every line break opens a paragraph."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")) if paragraphs else F.col("text")
    return documents(spark, sf_dir).select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
        F.octet_length("text").cast("bigint").alias("n_bytes"), text.alias("text"))


def _with_extra(docs: DataFrame, whole: list, extra: list[tuple]) -> DataFrame:
    """Every document as ``whole`` says, and beside it a row for each condition of ``extra`` that it meets.

    An array per document does this in streams as well.
    """
    rows = [F.struct(*whole)] + [F.when(condition, F.struct(*columns)) for condition, columns in extra]
    return docs.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def add_requests(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents as add requests, some without owner or metadata, and requests without text beside them."""
    docs = documents(spark, sf_dir) if docs is None else docs
    name, owner = F.col("doc_id").cast("string"), F.nullif("source", F.lit("src3"))
    metadata = F.when(F.col("lang") != "en", F.to_json(F.struct(F.col("lang"), F.concat(F.lit("d"), name).alias("file"))))

    def request(key, content):
        return [key.alias("request_id"), content.alias("content"), owner.alias("user_id"), metadata.alias("metadata")]

    return _with_extra(docs, request(name, F.col("text")), [
        (F.col("doc_id") % 50 == 0, request(F.concat(F.lit("none-"), name), F.lit(None).cast("string"))),
        (F.col("doc_id") % 50 == 1, request(F.concat(F.lit("blank-"), name), F.lit(" \n\t ")))])


def import_items(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents as JSON import items ``(user_id, pos, data)`` of every shape, and broken items beside them."""
    docs = documents(spark, sf_dir) if docs is None else docs

    def item(name):
        return F.to_json(F.struct(F.col("text").alias(name), F.struct("lang", "n_chars").alias("metadata")))

    def row(pos, data):
        return [F.lit("team").alias("user_id"), pos.alias("pos"), data.alias("data")]

    data = (F.when(F.col("doc_id") % 3 == 0, item("memory")).when(F.col("doc_id") % 3 == 1, item("text")).otherwise(item("content")))
    broken = {3: "17", 7: '"bare"', 11: '{"memory":"  ","text":"","metadata":{}}', 13: "[1,2]"}
    return _with_extra(docs, row(F.col("doc_id"), data), [
        (F.col("doc_id") % 20 == n, row(-F.col("doc_id") - 1, F.lit(text))) for n, text in broken.items()])


def import_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the import namespace holds already: the documents labelled good, padded."""
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    docs = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    return docs.select(F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("id"), F.lit("team").alias("user_id"),
                       F.concat(F.lit("  "), F.col("text"), F.lit(" \n")).alias("memory"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored points whose text sits under varying members, and points without text beside them."""
    base, n = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    owner, name = F.col("source").alias("user_id"), F.col("doc_id").cast("string")
    shapes = (
        F.when(n == 0, F.to_json(F.struct(F.col("text").alias("data"), owner, "lang", "n_chars")))
        .when(n == 1, F.to_json(F.struct(F.col("text").alias("memory"), owner, F.lit("2020-01-01").alias("created_at"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"), F.lit("x").alias("text_lemmatized"), "lang"))))
    empty = F.to_json(F.struct(F.lit("").alias("data"), F.col("text").alias("memory"), owner, F.lit("a1").alias("agent_id")))
    return _with_extra(base, [name.alias("id"), shapes.alias("payload")], [
        (F.col("doc_id") % 5 == 3, [F.concat(F.lit("empty-"), name).alias("id"), empty.alias("payload")]),
        (F.col("doc_id") % 5 == 4, [F.concat(F.lit("none-"), name).alias("id"), F.lit(None).cast("string").alias("payload")])])
