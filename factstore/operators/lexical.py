"""Keyword relevance (Okapi BM25), reported as its own column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factstore.operators.sizing import is_small

# The published Okapi parameters.
K1 = 1.2
B = 0.75
#: Sums (one for a query and a record that share a word) that a task makes, and records it takes, at most.
SUMS_PER_TASK, RECORDS_PER_TASK = 500_000, 20_000
#: Tasks at most; beyond, their sums grow and Spark spills them.
MOST_TASKS = 10_000
# Lower-case words: runs of letters and digits.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(c) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def _tasks(records: int, queries: int) -> int:
    """Partitions of the records, of which each has to be summed up with all queries."""
    each = min(RECORDS_PER_TASK, max(1, SUMS_PER_TASK // max(1, queries)))
    return max(1, min(MOST_TASKS, -(-records // each)))


def bm25(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, bm25, rank)``: the best ``k`` records sharing a term with each query.

    Statistics are per namespace.
    """
    asked = queries.select("query_id", "user_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    # Everything derived from the asked words has at most as many rows as they do.
    send = F.broadcast if is_small(asked) else (lambda df: df)
    wanted = send(asked.select("user_id", "term").distinct())
    spaces = send(queries.select("user_id").distinct())

    docs = (memories.select("id", "user_id", tokens("memory").alias("words"))
            .join(spaces, "user_id", "left_semi")
            .withColumn("length", F.size("words")))
    sizes = docs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    # The scan drops every word no query asked for. The rest is brought together by
    # record, which serves the counting here and the sum per query further down, so
    # the many (query, record, word) rows are never shuffled. A task holds a sum for each
    # of its records and queries, so their number decides how many tasks there are.
    # (The outer explode: a plain one would add a filter that splits each text twice.)
    matched = (docs.select("id", "user_id", "length", F.explode_outer("words").alias("term"))
               .join(wanted, ["user_id", "term"], "left_semi")
               .repartition(_tasks(memories.count(), queries.count()), "id")
               .groupBy("id", "user_id", "term", "length").agg(F.count(F.lit(1)).alias("tf")))
    spread = matched.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = (spread.join(sizes, "user_id")
               .withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
               .select("user_id", "term", "idf", "avg_length"))
    # One row per query and word, carrying the word's weight.
    terms = send(asked.join(weights, ["user_id", "term"]))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = (matched.join(terms, ["user_id", "term"])
              # Rounded so that the order of summation cannot decide a tie.
              .groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("bm25")))
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id")
    return (scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
