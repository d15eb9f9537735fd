"""One function per registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from factstore.functions.chunking import chunk_text
from factstore.functions.dates import parse_created_at
from factstore.functions.numbers import float_or, int_or
from factstore.functions.text import canonical_model, dedup_key, py_strip
from factstore.functions.vectors import cosine
from factstore.operators import audit, chunks, dedup, embed, lexical, mutate, records, search, validate, vector_index
from factstore.plans import inputs
from factstore.plans.inputs import AS_OF
from factstore.session import shared_folder
from factstore.sources import conversations, files, imports, markdown, tables
from factstore.sources.files import is_directory
from factstore.streaming import ingest

DUPLICATE_THRESHOLD = 0.3
CHUNK_LIMIT = 500
MESSAGES_PER_FILE = 500
ROWS_PER_RANGE = 100
ROWS_PER_CELL = 50


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("bigint"))


# Search

def search_topk(spark, sf_dir):
    store = inputs.vectors(spark, sf_dir)
    hits = search.search(store, inputs.first_vector(spark, sf_dir, "u0"), "u0")
    return _score(hits).select("rank", "id", "user_id", "score")


def search_floor(spark, sf_dir):
    store = inputs.vectors(spark, sf_dir)
    hits = search.search(store, inputs.first_vector(spark, sf_dir, "u1"), "u1", limit=50, min_score=0.1)
    return _score(hits).select("rank", "id", "score")


def search_no_scores(spark, sf_dir):
    store = inputs.vectors(spark, sf_dir)
    hits = search.search(store, inputs.first_vector(spark, sf_dir, "u2"), "u2", limit=5, include_scores=False)
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


def search_batch(spark, sf_dir):
    return _score(search.search_batch(inputs.vectors(spark, sf_dir), inputs.centroids(spark, sf_dir), 10))


def search_records(spark, sf_dir):
    """The best records of each namespace's mean vector, with their texts."""
    texts = inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("memory"))
    store = inputs.vectors(spark, sf_dir).join(texts, "id", "left")
    hits = search.search_records(store, inputs.centroids(spark, sf_dir), 10)
    return _score(hits).select("query_id", "rank", "user_id", "id", "score", F.md5("memory").alias("memory_md5"))


def search_batch_blocks(spark, sf_dir):
    """Every record is a query, met block by block."""
    store = inputs.vectors(spark, sf_dir)
    queries = store.withColumnRenamed("id", "query_id")
    return _score(search.search_batch(store, queries, 5, max_query_bytes=0, rows_per_block=100))


def search_approx(spark, sf_dir):
    """Every record whose id is divisible by 50 is a query, asked of a stored index by cells."""
    store, place = inputs.vectors(spark, sf_dir), shared_folder(spark, "vector-index")
    vector_index.write_index(store, place, ROWS_PER_CELL)
    queries = store.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")
    return _score(vector_index.search_index(spark, place, queries, 10))


def search_text(spark, sf_dir):
    """Benchmark passages searched in the documents through hashed vectors."""
    store = embed.embed_hash(inputs.memories(spark, sf_dir, wide=True).withColumn("user_id", F.lit("corpus")), 256)
    queries = inputs.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("corpus").alias("user_id"), F.col("text").alias("query"))
    hits = search.search_text(store, queries, lambda q: embed.embed_hash(q, 256, "query"), 5)
    return _score(hits)


def cosine_to_centroid(spark, sf_dir):
    store = inputs.vectors(spark, sf_dir)
    middle = inputs.centroids(spark, sf_dir).select("user_id", F.col("embedding").alias("center"))
    return store.join(middle, "user_id").select("id", F.round(cosine("embedding", "center"), 4).alias("score"))


def near_duplicates(spark, sf_dir):
    found = search.near_duplicates(inputs.vectors(spark, sf_dir), DUPLICATE_THRESHOLD)
    return found.withColumn("score", F.round("score", 4))


def near_duplicates_blocks(spark, sf_dir):
    """The same check with blocks so small that every namespace is cut into many."""
    found = search.near_duplicates(inputs.vectors(spark, sf_dir), DUPLICATE_THRESHOLD, rows_per_block=10)
    return found.withColumn("score", F.round("score", 4))


def near_duplicates_bucketed(spark, sf_dir):
    """The same check among many cells, each cut into blocks."""
    found = search.near_duplicates(inputs.vectors(spark, sf_dir), DUPLICATE_THRESHOLD, ROWS_PER_CELL, rows_per_block=50)
    return found.withColumn("score", F.round("score", 4))


def bm25_scores(spark, sf_dir):
    store = inputs.memories(spark, sf_dir, wide=True).withColumn("user_id", F.lit("corpus"))
    queries = inputs.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("corpus").alias("user_id"), F.col("text").alias("query"))
    best = lexical.bm25(store, queries, 10)
    return best.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("bm25", 4).alias("bm25"))


def embed_hash(spark, sf_dir):
    rows = embed.embed_hash(inputs.memories(spark, sf_dir, wide=True), 64)
    return rows.select("id", F.size("embedding").cast("bigint").alias("dims"),
                       F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x), 3).alias("squared_norm"))


def _letter_counts():
    def encode(texts):
        return np.array([[len(t), t.count(" "), t.count("e"), 1.0] for t in texts])
    return encode


def embed_encoder(spark, sf_dir):
    """A caller's encoder, here one that counts characters."""
    rows = embed.embed(inputs.memories(spark, sf_dir, wide=True), _letter_counts, 4)
    return rows.select("id", *[F.col("embedding")[i].cast("bigint").alias(n)
                               for i, n in enumerate(("chars", "blanks", "letters_e", "one"))])


# Listings

def list_namespace(spark, sf_dir):
    rows = records.list_namespace(inputs.memories(spark, sf_dir), "src1", None)
    return rows.select("id", F.md5("memory").alias("memory_md5"), "metadata", "created_at")


def page_2(spark, sf_dir):
    rows = records.page(inputs.memories(spark, sf_dir), limit=10, page=2)
    return rows.select("user_id", F.col("position").cast("bigint").alias("position"), "id")


def page_of_namespace(spark, sf_dir):
    return records.page(inputs.memories(spark, sf_dir), "src5", limit=7, page=2).select("id", "created_at")


def page_far(spark, sf_dir):
    """A page behind the middle of each namespace of a stored listing, of which two ranges of a namespace are read."""
    place = shared_folder(spark, "listing")
    tables.write_listing(inputs.memories(spark, sf_dir), place, ROWS_PER_RANGE)
    rows = tables.listing_page(spark, place, None, 10, 4)
    one = tables.listing_page(spark, place, "src5", 7, 6)
    return rows.select(F.lit("each").alias("of"), "user_id", F.col("position").cast("bigint").alias("position"), "id").union(
        one.select(F.lit("src5"), "user_id", F.col("position").cast("bigint"), "id"))


def get_by_ids(spark, sf_dir):
    """Ids of all labelled documents and of all pages; the latter are unknown."""
    labelled = inputs.table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("memory_id"))
    unknown = inputs.table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("memory_id"))
    got = records.lookup(inputs.memories(spark, sf_dir), labelled.union(unknown))
    return got.select("id", "found", "user_id", "message")


def get_stored_ids(spark, sf_dir):
    """The first labelled documents of each source, looked up in a stored table."""
    place = shared_folder(spark, "records")
    tables.append(inputs.memories(spark, sf_dir), place)
    docs = inputs.table(spark, sf_dir, "documents").join(inputs.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    asked = docs.groupBy("source").agg(F.min("doc_id").alias("first")).select(
        F.concat(F.lit("doc-"), F.col("first").cast("string")).alias("memory_id"))
    got = tables.find(spark, place, asked.union(asked.select(F.concat("memory_id", F.lit("-none")))))
    return got.select("id", "found", "user_id", F.md5("memory").alias("memory_md5"))


def _entity_rows(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("agent_id"),
        F.get_json_object("props", "$.k").alias("app_id"), F.lit(None).cast("string").alias("run_id"))


def entities(spark, sf_dir):
    return records.list_entities(_entity_rows(spark, sf_dir))


def listing_stats(spark, sf_dir):
    return records.listing_stats(_entity_rows(spark, sf_dir))


def grep_records(spark, sf_dir):
    found = records.grep_records(inputs.memories(spark, sf_dir), 'LANG":"de')
    text = records.grep_records(inputs.memories(spark, sf_dir), "License")
    return found.select("id", F.lit("metadata").alias("hit")).union(text.select("id", F.lit("text").alias("hit")))


def entity_filter(spark, sf_dir):
    return records.of_entity(inputs.memories(spark, sf_dir), "src2").select("id", "user_id")


def listing_cards(spark, sf_dir):
    cards = records.listing_cards(inputs.memories(spark, sf_dir, scored=True))
    return cards.withColumn("card_text", F.md5("card_text"))


def flatten_payload(spark, sf_dir):
    flat = records.flatten_payload(inputs.payloads(spark, sf_dir))
    return flat.select("id", F.md5("memory").alias("memory_md5"), "user_id", "agent_id", "created_at", "metadata")


def conversation_memories(spark, sf_dir):
    return conversations.conversations_to_memories(inputs.table(spark, sf_dir, "conversations"))


# Validation and scalars

def validate_facts(spark, sf_dir):
    checked = validate.validate_add(validate.with_namespace(inputs.add_requests(spark, sf_dir)))
    return checked.select("request_id", "user_id", "error_code", "message", "fix")


def validate_updates(spark, sf_dir):
    requests = inputs.add_requests(spark, sf_dir).withColumn("memory_id", F.col("user_id"))
    return validate.validate_updates(requests).select("request_id", "error_code", "message")


def validate_queries(spark, sf_dir):
    requests = inputs.add_requests(spark, sf_dir).withColumnRenamed("content", "query")
    return validate.rejects(validate.validate_queries(requests)).select("request_id", "error_code", "message")


def validate_ids(spark, sf_dir):
    """Requests that name an entity, some of them with an empty name."""
    requests = _entity_rows(spark, sf_dir).select(F.nullif("agent_id", F.lit("error")).alias("user_id"))
    return validate.validate_ids(requests, "user_id").groupBy("user_id", "error_code", "message").agg(
        F.count(F.lit(1)).alias("n"))


def validate_batches(spark, sf_dir):
    """Conversations as import batches, some of them broken."""
    made = conversations.conversations_to_memories(inputs.table(spark, sf_dir, "conversations"))
    n = F.col("conv_id") % 9
    data = (F.when(n == 1, " ").when(n == 2, F.concat(F.lit("x"), "memory")).when(n == 3, F.concat("memory", F.lit(" x")))
            .when(n == 4, '{"memory":"a"}').when(n == 5, "[]").when(n == 6, F.lit(None)).otherwise(F.col("memory")))
    owner = F.when(n == 7, " \t").when(n == 8, F.lit(None)).otherwise(F.col("conv_id").cast("string"))
    checked = validate.validate_batches(made.select("conv_id", owner.alias("user_id"), data.alias("data")))
    return checked.select("conv_id", "error_code", "message")


def short_docs(spark, sf_dir):
    return validate.skip_short(inputs.document_files(spark, sf_dir)).select("file")


def parse_dates(spark, sf_dir):
    return inputs.memories(spark, sf_dir).select("id", parse_created_at("created_at").alias("epoch"))


def dedup_keys(spark, sf_dir):
    padded = F.concat(F.lit("　 \x1c"), F.col("text"), F.lit("\x85\n"))
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(dedup_key(padded)).alias("dedup_md5"), F.length(py_strip(padded)).cast("bigint").alias("chars"))


def canonical_models(spark, sf_dir):
    name = (F.when(F.col("event_type") == "click", " nomic-embed-text ")
            .when(F.col("event_type") == "view", "nomic-embed-text:v1.5").otherwise(F.concat(F.col("event_type"), F.lit("\n"))))
    return (inputs.table(spark, sf_dir, "events").select(canonical_model(name).alias("model"))
            .groupBy("model").agg(F.count(F.lit(1)).alias("n")))


def tolerant_numbers(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_type") == "error", F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit(" "), k))
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", int_or(raw, -1).alias("as_int"), float_or(F.concat(raw, F.lit(".5 ")), -1.0).alias("as_float"))


# Chunking

def _pieces(df, key, pieces):
    return df.select(key, F.size(pieces).cast("bigint").alias("n_chunks"),
                     F.md5(F.array_join(pieces, "\x01")).alias("chunks_md5"))


def chunk_texts(spark, sf_dir):
    """Exact chunks of every document."""
    docs = inputs.documents(spark, sf_dir).withColumn("pieces", chunk_text("text", CHUNK_LIMIT))
    return _pieces(docs, "doc_id", F.col("pieces"))


def chunk_paragraphs(spark, sf_dir):
    """Exact chunks when every line is a paragraph of its own, without repetition."""
    docs = inputs.documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = docs.withColumn("pieces", chunk_text("text", CHUNK_LIMIT, compat=False))
    return _pieces(docs, "doc_id", F.col("pieces"))


def _whole(rows):
    """Number of chunks of each request, and the digest of all of them in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "memory")))
    return rows.groupBy("request_id", "user_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.md5(F.array_join(F.transform(ordered, lambda r: r["memory"]), "\x01")).alias("chunks_md5"))


def chunk_profile(spark, sf_dir):
    """Exact chunks of verbatim ingest at the default limit."""
    rows, _ = chunks.add_verbatim(inputs.add_requests(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string")))
    return _whole(rows)


def _digests(rows, key, order):
    """Number of chunks, and the digests of all chunks and of all their metadata in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "memory", F.coalesce("metadata", F.lit("")).alias("metadata"))))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), ordered.alias("_rows")).select(
        key, "n_chunks", F.md5(F.array_join(F.col("_rows.memory"), "\x01")).alias("chunks_md5"),
        F.md5(F.array_join(F.col("_rows.metadata"), "\x01")).alias("metadata_md5"))


def verbatim_headers(spark, sf_dir):
    """Exact chunks and metadata of verbatim ingest under headers, at a limit most documents exceed."""
    requests = inputs.add_requests(spark, sf_dir).withColumn("content", F.trim("content"))
    rows, _ = chunks.add_verbatim(requests, max_chars=CHUNK_LIMIT)
    return _digests(rows, "request_id", ["pos"])


def add_facts(spark, sf_dir):
    """Single facts that are stored, as they are."""
    rows, _ = chunks.add_facts(inputs.add_requests(spark, sf_dir))
    return rows.select("request_id", "user_id", F.md5("memory").alias("memory_md5"), "metadata")


def verbatim_rejects(spark, sf_dir):
    _, failed = chunks.add_verbatim(inputs.add_requests(spark, sf_dir))
    return failed.select("request_id", "user_id", "error_code", "message", "fix")


def chunk_reports(spark, sf_dir):
    """Number and ids of the chunks stored for each request, in order."""
    rows, _ = chunks.add_verbatim(inputs.add_requests(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string")))
    report = chunks.chunk_report(rows.withColumn("id", F.concat_ws("-", "request_id", "pos")))
    return report.select("request_id", "chunks", F.array_join("results", ",").alias("ids"))


def plan_import(spark, sf_dir):
    return chunks.plan_import(inputs.document_files(spark, sf_dir), CHUNK_LIMIT)


def import_documents(spark, sf_dir):
    """Exact chunks of the document importer, with header, tag and metadata."""
    return _digests(chunks.import_documents(inputs.document_files(spark, sf_dir), "team"), "file", ["part", "pos"])


def markdown_files(spark, sf_dir):
    """Markdown files of several folders, hidden ones among them, read back.

    A file holds the digests of fifty documents, with line ends of another system.
    """
    place, k = shared_folder(spark, "markdown"), F.floor(F.col("doc_id") / 50)
    line = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\r\n"), F.md5("text"))
    # The lines of a document are two, and each line end but the last is one character longer.
    made = inputs.table(spark, sf_dir, "documents").groupBy(k.alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("lines"))
    folder = (F.when(F.col("k") % 6 == 0, "a/").when(F.col("k") % 6 == 1, "node_modules/").when(F.col("k") % 6 == 2, "b/.hidden/")
              .when(F.col("k") % 6 == 3, "b/_own/").otherwise(""))
    start = F.when(F.col("k") % 5 == 0, ".").when(F.col("k") % 5 == 1, "_").otherwise("f")
    ending = F.when(F.col("k") % 7 == 0, ".txt").otherwise(".md")
    text = F.array_join(F.transform("lines", lambda r: r["line"]), "\r\n")
    files.write_files(made.select(F.concat(folder, start, F.col("k").cast("string"), ending).alias("file"), text.alias("text")), place)
    return markdown.read_markdown(spark, place).select("file", "n_bytes", F.md5("text").alias("text_md5"))


def rechunk_documents(spark, sf_dir):
    """Importer chunks above the store's limit are packed a second time."""
    rows = chunks.import_documents(inputs.document_files(spark, sf_dir), "team", 2000, CHUNK_LIMIT)
    return rows.groupBy("file").agg(F.max(F.length("memory") <= CHUNK_LIMIT).alias("within_limit"))


def document_report(spark, sf_dir):
    return chunks.document_report(chunks.document_status(inputs.document_files(spark, sf_dir)))


# Import and mutation

def _import(spark, sf_dir):
    items = inputs.import_items(spark, sf_dir).withColumn("item", F.try_parse_json("data")).drop("data")
    return dedup.import_memories(imports.parse_items(items), inputs.import_store(spark, sf_dir))


def import_new_rows(spark, sf_dir):
    return _import(spark, sf_dir).new_rows.select("pos", "user_id", F.md5("memory").alias("memory_md5"), "metadata")


def import_rejects(spark, sf_dir):
    return _import(spark, sf_dir).rejects.select("pos", "error_code", "message")


def import_report(spark, sf_dir):
    report = dedup.import_report(_import(spark, sf_dir))
    shown = F.array_join(F.transform("errors", lambda e: F.concat(e["message"], F.lit(" x"), e["n"].cast("string"))), "; ")
    return report.withColumn("errors", shown)


def import_status(spark, sf_dir):
    return dedup.import_status(_import(spark, sf_dir)).select("pos", "status")


def import_array(spark, sf_dir):
    """Batches with one JSON array per source, checked and unpacked."""
    messages = inputs.table(spark, sf_dir, "conversations")
    batches = conversations.conversations_to_memories(messages).select(
        F.col("conv_id").cast("string").alias("user_id"), F.col("memory").alias("data"))
    valid = validate.accepted(validate.validate_batches(batches))
    return imports.read_json_array(valid).select("user_id", "pos", "item_type", F.md5("memory").alias("memory_md5"))


def union_store(spark, sf_dir):
    store = inputs.import_store(spark, sf_dir)
    both = dedup.union_store(store, _import(spark, sf_dir).new_rows)
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("id", F.lit("old-"))).alias("kept"))


def _updates(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("memory_id"),
        F.when(F.col("toxic") == 1, " ").otherwise(F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("content"))
    pages = inputs.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("memory_id"), F.col("url").alias("content"))
    return labels.union(pages)


def update_text(spark, sf_dir):
    store, _ = mutate.update_memories(inputs.memories(spark, sf_dir), _updates(spark, sf_dir))
    return store.select("id", "user_id", F.md5("memory").alias("memory_md5"))


def update_rejects(spark, sf_dir):
    _, failed = mutate.update_memories(inputs.memories(spark, sf_dir), _updates(spark, sf_dir))
    return failed.select("memory_id", "error_code", "message")


def delete_ids(spark, sf_dir):
    store, _ = mutate.delete_memories(inputs.memories(spark, sf_dir), _updates(spark, sf_dir).select("memory_id"))
    return store.select("id", "user_id")


def delete_rejects(spark, sf_dir):
    _, failed = mutate.delete_memories(inputs.memories(spark, sf_dir), _updates(spark, sf_dir).select("memory_id"))
    return failed.select("memory_id", "error_code", "message")


def delete_namespace(spark, sf_dir):
    return mutate.delete_namespace(inputs.memories(spark, sf_dir), "src4").select("id", "user_id")


def delete_entity(spark, sf_dir):
    return mutate.delete_entity(inputs.memories(spark, sf_dir), "src2").select("id", "user_id")


def update_then_search(spark, sf_dir):
    """Texts replaced and embedded anew, then searched: the vectors are those of the new texts."""
    encode = lambda df, text="memory": embed.embed(df, _letter_counts, 4, text)
    store = encode(inputs.memories(spark, sf_dir, wide=True)).withColumn("user_id", F.lit("corpus"))
    changed, _ = mutate.update_memories(store, _updates(spark, sf_dir), encode)
    queries = inputs.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("corpus").alias("user_id"), F.col("text").alias("query"))
    return _score(search.search_text(changed, queries, lambda q: encode(q, "query"), 5))


def delete_namespaces(spark, sf_dir):
    """Namespaces without a single good label are removed."""
    scored = inputs.memories(spark, sf_dir, scored=True)
    weak = scored.groupBy("user_id").agg(F.avg("score").alias("mean")).where(F.col("mean") < 0.85)
    return mutate.anti_by(inputs.memories(spark, sf_dir), weak, "user_id").select("id", "user_id")


def prune_dry_run(spark, sf_dir):
    return mutate.prune(inputs.memories(spark, sf_dir), AS_OF, 365).report


def prune_candidates(spark, sf_dir):
    found = mutate.prune(inputs.memories(spark, sf_dir), AS_OF, 365).candidates
    return found.select("id", F.md5("memory").alias("preview_md5"), "created_at")


def prune_apply(spark, sf_dir):
    return mutate.prune(inputs.memories(spark, sf_dir), AS_OF, 365, dry_run=False).store.select("id", "user_id")


def prune_min_score(spark, sf_dir):
    scored = inputs.memories(spark, sf_dir, scored=True)
    return mutate.prune(scored, AS_OF, 365, dry_run=False, min_score=0.5).store.select("id")


# Export and storage

def export_records(spark, sf_dir):
    rows = records.export_records(inputs.memories(spark, sf_dir))
    return rows.withColumn("memory", F.md5("memory"))


def export_csv_lines(spark, sf_dir):
    rows = records.export_records(inputs.memories(spark, sf_dir))
    return tables.csv_rows(rows).select(F.md5("value").alias("line_md5"), F.length("value").cast("bigint").alias("chars"))


def export_csv_file(spark, sf_dir):
    """The written CSV document, read back."""
    place = shared_folder(spark, "csv")
    tables.export_csv(records.export_records(inputs.memories(spark, sf_dir)), place)
    back = spark.read.csv(place, schema="id string, memory string, metadata string, created_at string, user_id string",
                          multiLine=True, escape='"', lineSep="\r\n", emptyValue="")
    return back.select("id", F.md5("memory").alias("memory_md5"), "metadata",
                       F.coalesce("created_at", F.lit("")).alias("created_at"), "user_id")


def export_csv_quoted(spark, sf_dir):
    rows = records.export_records(inputs.memories(spark, sf_dir))
    return tables.csv_rows(rows, "quoted").select(F.md5("value").alias("line_md5"))


def export_manifest(spark, sf_dir):
    return tables.export_manifest(records.export_records(inputs.memories(spark, sf_dir)))


def stored_namespace(spark, sf_dir):
    """Append the records to a table in the shared folder and scan one namespace of it."""
    place = shared_folder(spark, "records")
    tables.append(inputs.memories(spark, sf_dir), place)
    return tables.scan(spark, place, "src6").select("id", F.md5("memory").alias("memory_md5"), "created_at")


def snapshot_after_prune(spark, sf_dir):
    """Store a version, prune it into a second one bucket by bucket, read the newest."""
    root = shared_folder(spark, "snapshots")
    tables.write_snapshot(inputs.memories(spark, sf_dir), root)
    tables.change_snapshot(spark, root, lambda store: store.where(records.older_than(365, AS_OF)),
                           lambda store: mutate.prune(store, AS_OF, 365, dry_run=False).store)
    return tables.read_snapshot(spark, root).select("id", "user_id")


def export_round_trip(spark, sf_dir):
    """Export as JSON Lines, import into a new namespace, then import once more."""
    place = shared_folder(spark, "export")
    tables.export_json(records.export_records(inputs.memories(spark, sf_dir)), place)
    items = imports.read_import(spark, f"{place}/memories", "jsonl").withColumn("user_id", F.lit("copy"))
    empty = inputs.import_store(spark, sf_dir).where(F.lit(False))
    first = dedup.import_memories(items, empty, batch="first")
    second = dedup.import_memories(items, first.new_rows, batch="second")
    both = [dedup.import_report(r).select(F.lit(i).alias("run"), "imported", "skipped", "failed")
            for i, r in (("first", first), ("second", second))]
    return both[0].union(both[1])


def import_csv(spark, sf_dir):
    """Export as CSV and read the files back as import items; every part has the header."""
    place = shared_folder(spark, "csv")
    rows = records.export_records(inputs.memories(spark, sf_dir, wide=True))
    rows.write.csv(place, header=True, quote='"', escape='"', quoteAll=True)
    return imports.read_import(spark, place, "csv").select(F.md5("memory").alias("memory_md5"), "item_type", "metadata")


def csv_round_trip(spark, sf_dir):
    """The own CSV export of many parts, whose first part alone has the header."""
    place = shared_folder(spark, "csv")
    tables.export(inputs.memories(spark, sf_dir, wide=True), place, "csv")
    return imports.read_import(spark, place).select(F.md5("memory").alias("memory_md5"), "item_type", "metadata")


def import_json_files(spark, sf_dir):
    """Pretty-printed arrays and envelopes, one value for each file, told apart by content.

    Every range of messages gives an array and an envelope, so files stay small and grow in number.
    """
    place = shared_folder(spark, "json")
    messages = F.to_json(F.array_sort(F.collect_list(F.struct("conv_id", "turn", F.col("text").alias("memory")))), {"pretty": "true"})
    # Ids count up within a task, whatever values the rows have.
    rows = inputs.table(spark, sf_dir, "conversations").withColumn("_at", F.monotonically_increasing_id())
    place_of = F.floor(F.col("_at") / (2 * MESSAGES_PER_FILE)) * 2 + F.col("_at") % 2
    made = rows.groupBy(place_of.alias("k")).agg(messages.alias("items"))
    wrapped = F.concat(F.lit('{"format": "json",\n"memories": '), F.col("items"), F.lit("}"))
    value = F.when(F.col("k") % 2 == 0, F.col("items")).otherwise(wrapped).alias("value")
    made.select(value, "k").write.partitionBy("k").text(place)
    found = imports.read_import(spark, f"{place}/*")
    return found.select("item_type", F.md5("memory").alias("memory_md5"))


def import_ids_unique(spark, sf_dir):
    """Every imported record has an id of its own, the same in a second run over other partitions."""
    def ids(items):
        parsed = imports.parse_items(items.withColumn("item", F.try_parse_json("data")).drop("data"))
        return dedup.import_memories(parsed, inputs.import_store(spark, sf_dir)).new_rows.select("id", "pos")
    items = inputs.import_items(spark, sf_dir)
    both = ids(items).unionByName(ids(items.repartition(7)))
    return both.groupBy("pos").agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("runs"))


def prune_legacy_ids(spark, sf_dir):
    """Half of the rows carry their id as memory_id, as older stores do."""
    rows = inputs.memories(spark, sf_dir)
    old = F.substring("id", -1, 1).isin("1", "3", "5", "7", "9")
    legacy = rows.withColumn("memory_id", F.when(old, F.col("id"))).withColumn("id", F.when(~old, F.col("id")))
    kept = mutate.prune(legacy, AS_OF, 365, dry_run=False).store
    return kept.select(F.coalesce("id", "memory_id").alias("id"), "user_id")


def audit_dims(spark, sf_dir):
    store = inputs.table(spark, sf_dir, "embeddings")
    cut = store.withColumn("embedding", F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    report = audit.audit_dims({"records": store, "migrations": cut}, 64)
    return report.withColumn("dim", F.col("dim").cast("bigint"))


def audit_strict(spark, sf_dir):
    """What the strict audit says of a collection with two sizes, and of one that conforms."""
    store = inputs.table(spark, sf_dir, "embeddings")
    cut = store.withColumn("embedding", F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    found = []
    for name, df in (("cut", cut), ("whole", store)):
        try:
            audit.enforce_dims({name: df}, 64)
            found.append((name, None))
        except audit.DimensionMismatch as error:
            found.append((name, str(error)))
    return spark.createDataFrame(found, "collection string, refusal string")


def audit_settings(spark, sf_dir):
    """The vector size that each collection's setting names, in every shape a setting has."""
    sizes = inputs.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).cast("string").alias("n"))
    plain = F.concat(F.lit('{"size":'), F.col("n"), F.lit(',"distance":"Cosine"}'))
    config = (F.when(F.col("label") % 5 == 0, plain).when(F.col("label") % 5 == 1, F.concat(F.lit('{"text":'), plain, F.lit("}")))
              .when(F.col("label") % 5 == 2, F.concat(F.lit("["), plain, F.lit("]"))).when(F.col("label") % 5 == 3, "{}"))
    return sizes.select("label", F.coalesce(audit.config_dims(config), F.lit(0)).cast("bigint").alias("dims"))


def audit_drop(spark, sf_dir):
    store = inputs.table(spark, sf_dir, "embeddings")
    cut = store.withColumn("embedding", F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return audit.enforce_dims({"cut": cut}, 64, "drop")["cut"].select("vec_id", "label")


# Streams, run to completion over the given tables

def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_directory(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_ingest(spark, sf_dir):
    target = shared_folder(spark, "ingest")
    requests = inputs.add_requests(spark, sf_dir, _stream(spark, sf_dir, "documents"))
    plain = requests.withColumn("metadata", F.lit(None).cast("string"))
    ingest.ingest_stream(plain, target, f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _whole(spark.read.parquet(f"{target}/records"))


def stream_rejects(spark, sf_dir):
    target = shared_folder(spark, "ingest")
    requests = inputs.add_requests(spark, sf_dir, _stream(spark, sf_dir, "documents"))
    (ingest.ingest_stream(requests, target, f"{target}/checkpoint", mode="fact")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{target}/rejects").select("request_id", "user_id", "error_code", "message", "fix")


def stream_import(spark, sf_dir):
    target = shared_folder(spark, "import")
    ingest.write_base_keys(inputs.import_store(spark, sf_dir), f"{target}/base")
    items = inputs.import_items(spark, sf_dir, _stream(spark, sf_dir, "documents"))
    (ingest.import_stream(items, target, f"{target}/checkpoint", f"{target}/base")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{target}/records").select("pos", "user_id", F.md5("memory").alias("memory_md5"), "metadata")


QUERIES = {f.__name__: f for f in (
    search_topk, search_floor, search_no_scores, search_batch, search_records, search_batch_blocks, search_approx, search_text,
    cosine_to_centroid, near_duplicates, near_duplicates_blocks, near_duplicates_bucketed, bm25_scores, embed_hash, embed_encoder,
    list_namespace, page_2, page_of_namespace, page_far, get_by_ids, get_stored_ids, entities, listing_stats, grep_records, entity_filter,
    listing_cards, flatten_payload, conversation_memories, validate_facts, validate_updates, validate_queries,
    validate_ids, validate_batches, short_docs, parse_dates, dedup_keys, canonical_models, tolerant_numbers, chunk_texts, chunk_paragraphs,
    chunk_profile, verbatim_headers, add_facts, markdown_files, verbatim_rejects, chunk_reports, plan_import, import_documents, rechunk_documents, document_report,
    import_new_rows, import_rejects, import_report, import_status, import_array, union_store, update_text,
    update_rejects, delete_ids, delete_rejects, delete_namespace, delete_entity, update_then_search, delete_namespaces, prune_dry_run, prune_candidates,
    prune_apply, prune_min_score, export_records, export_csv_lines, export_csv_file, export_csv_quoted, export_manifest,
    stored_namespace, snapshot_after_prune, export_round_trip, import_csv, csv_round_trip, import_json_files, import_ids_unique, prune_legacy_ids, audit_dims, audit_strict, audit_settings, audit_drop, stream_ingest,
    stream_rejects, stream_import)}
