"""Text to fixed-dimension vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from factstore.operators.lexical import tokens
from factstore.schema import EMBED_DIMS

Encoder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, encoder: Callable[[], Encoder], dims: int = EMBED_DIMS,
          text: str = "memory", output: str = "embedding") -> DataFrame:
    """Encode ``text`` in batches.

    ``encoder`` is a factory: it runs once per task, so a model is loaded once and
    reused for every batch. A vector of another size fails the job.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            vectors = np.asarray(model(batch.fillna("").tolist()), dtype=np.float32)
            if len(batch) and vectors.shape != (len(batch), dims):
                raise ValueError(f"encoder returned {vectors.shape}, expected ({len(batch)}, {dims})")
            yield pd.Series(list(vectors), index=batch.index, dtype=object)

    return df.withColumn(output, encode(F.col(text)))


def embed_hash(df: DataFrame, dims: int = EMBED_DIMS, text: str = "memory", output: str = "embedding") -> DataFrame:
    """Deterministic vectors without a model: hashed word counts scaled to length one."""
    words = df.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))
    counted = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_counts").transform(words)
    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return (scaled.withColumn(output, vector_to_array("_unit", dtype="float32"))
            .drop("_words", "_counts", "_unit"))
