"""Token counts behind a cache of digests.

A text's count is stored under the digest of its normalised content and the digest of
the tokenizer that counted it. A run joins its rows to the stored counts by both, encodes
one row of each digest that has none, and appends those counts to the cache. Texts stay
where they are until a digest turns out to be missing.

Normalising may not change a count, so it only makes a null text an empty one. Empty
texts have no tokens. Rows with equal texts, and rows that repeat altogether, share one
stored count and each get their result row; null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from factstore.llm.common import text_slices, worker_state
from factstore.llm.segments import SPLIT, SegmentCoder, byte_chars
from factstore.operators.sizing import is_small

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens bigint"


def read_tokenizer(path: str) -> tuple[str, bytes]:
    """The kind of a tokenizer file by its ending, and its content (a few MB at most, whatever the data)."""
    with open(path, "rb") as file:
        return os.path.splitext(path)[1], file.read()


def tokenizer_digest(tokenizer: tuple[str, bytes]) -> str:
    return hashlib.sha256(tokenizer[0].encode() + b"\0" + tokenizer[1]).hexdigest()


def library_coder(content: bytes, ranked: bool = False) -> SegmentCoder:
    """Pieces encoded for a byte-level vocabulary, by the tokenizers library or, if ``ranked``, by tiktoken.

    ``ranked`` says that ``merges_by_id`` holds, where both give the same ids.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for text, i in tokenizer.get_vocab().items():
        lengths[i] = len(text.encode()) if text in added else len(text)

    def encode_all(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_ranked(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ranks.encode_ordinary(t), "<u4") for t in texts]

    if ranked:
        import tiktoken

        as_byte = {c: b for b, c in byte_chars()}
        ranks = tiktoken.Encoding("ranked", pat_str=SPLIT, special_tokens={}, mergeable_ranks={
            bytes(as_byte[c] for c in text): i for text, i in tokenizer.get_vocab().items() if text not in added})
    return SegmentCoder(encode_ranked if ranked else encode_all, lengths, added, most_bytes=100_000_000)


def merges_by_id(tokenizer: tuple[str, bytes]) -> bool:
    """Whether merging the pair with the smallest resulting id always does the vocabulary's own merges.

    So it is if every token longer than a byte comes from one merge, later merges give larger
    ids, and every token's own bytes merge into it: two neighbours whose join is a token then
    are the parts of its merge.
    """
    from tokenizers import Tokenizer

    if not is_byte_level(tokenizer):
        return False
    model = json.loads(tokenizer[1])["model"]
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") \
            or model.get("end_of_word_suffix"):
        return False
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    own = Tokenizer.from_str(tokenizer[1].decode())
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    plain = {t: i for t, i in model["vocab"].items() if t not in special}
    return (made == sorted(set(made)) and len(made) == sum(len(t) > 1 for t in plain)
            and {c for _, c in byte_chars()} <= plain.keys()
            and all([x.id for x in own.model.tokenize(t)] == [i] for t, i in plain.items()))


def is_byte_level(tokenizer: tuple[str, bytes]) -> bool:
    """Whether texts may be cut at blanks: no normaliser, and the byte-level split without a prefix."""
    if tokenizer[0] != ".json":
        return False
    spec = json.loads(tokenizer[1])
    split = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens") or []))


def counter(tokenizer: tuple[str, bytes], ranked: bool = False):
    """A function from texts (no nulls) to token counts, made once for each worker."""
    kind, content = tokenizer
    if kind == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(pieces.encode(t)) for t in texts.to_pylist()]
    if is_byte_level(tokenizer):
        coder = library_coder(content, ranked)
        return lambda texts: np.diff(coder.pack(texts)[1])
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(content.decode())
    whole.no_padding()
    whole.no_truncation()
    return lambda texts: [len(e.ids) for e in whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    # A run that was repeated may have appended a count twice.
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: tuple[str, bytes], cache: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``cache`` grows by the distinct misses."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    content = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", content.alias("text"), F.sha2(F.encode(content, "UTF-8"), 256).alias("digest"))

    # Digests alone tell what is missing; a copy of each missing text is chosen in the tasks that
    # read it, and only then are texts moved. Many missing texts are folded before the join.
    missing = keyed.select("digest").distinct().join(_stored(spark, cache, version), "digest", "left_anti")
    one = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    content = keyed.select("digest", "text")
    chosen = (one(content.join(F.broadcast(missing), "digest", "left_semi")) if is_small(missing)
              else one(content).join(missing, "digest", "left_semi"))
    ranked = merges_by_id(tokenizer)

    def run(batches):
        count = worker_state(f"counter-{version}", lambda: counter(tokenizer, ranked))
        for batch, texts in text_slices(batches):
            yield pa.record_batch([batch.column("digest"), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    counted = chosen.mapInArrow(run, "digest string, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    found = _stored(spark, cache, version)
    return (keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
            .join(found, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
