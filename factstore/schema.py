"""The record shapes every operator reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The entity keys of a record, the default namespace and limits.
ENTITY_KEYS = ("user_id", "agent_id", "app_id", "run_id")
DEFAULT_USER_ID = "dev"
CHUNK_CHARS = 3000
EMBED_DIMS = 768
LIST_LIMIT = 50
SEARCH_LIMIT = 10
PRUNE_DAYS = 30
MIN_DOCUMENT_CHARS = 50
PREVIEW_CHARS = 200
DUPLICATE_SCORE = 0.85
EXPORT_COLUMNS = ("id", "memory", "metadata", "created_at", "user_id")

RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("memory", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

ADD_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("metadata", T.StringType()),
])
