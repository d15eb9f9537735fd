"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are words, pairs of neighbours and pairs with one word between them, hashed into
``DIMENSIONS`` places; a text has a feature or not. Each coordinate learns at its own rate,
and the L1 term leaves the weights of features that say nothing at exactly zero, so the
weights that remain are few and travel with the scoring tasks.

Learning passes a few times over a sample of at most ``SAMPLE`` labelled documents, chosen
by a hash of the id among all labelled rows outside the held-out fold; a long text gives
its features like any other. Rows with a null label, null id or null text are not learned
from; a document with several labels counts once, by the largest. Without labels, or with
labels of one kind, the score follows the bias alone. A null or empty text scores as a text
without features. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factstore.llm.common import fold, slices, worker_state

DIMENSIONS = 1 << 20
#: Bound of the learning sample, in documents.
SAMPLE = 12_000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
#: Passes over the sample.
PASSES = 5
THRESHOLD = 0.3
_KEPT = 200_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _hashes(text: str) -> np.ndarray:
    """One number for each word; a worker keeps the numbers of words it has met."""
    known = worker_state("toxicity-words", dict)
    if len(known) > _KEPT:
        known.clear()
    found = text.encode().translate(_FOLD).split()
    get = known.get
    out = list(map(get, found))
    if None in out:
        for i, (word, number) in enumerate(zip(found, out)):
            if number is None:
                out[i] = known[word] = zlib.crc32(word) + 1
    return np.array(out, np.uint64)


def features(text: str) -> np.ndarray:
    """Places of all features in the order of the text, repeats included."""
    h = _hashes(text)
    k = np.uint64(0x9E3779B97F4A7C15)
    mixed = [h * k, (h[:-1] * np.uint64(31) + h[1:] * np.uint64(1_000_003)) * k,
             (h[:-2] * np.uint64(131) + h[2:] * np.uint64(7_368_787) + np.uint64(1)) * k]
    return (np.concatenate(mixed) >> np.uint64(64 - 20)).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, x))))


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal: the places and values of the weights that are not zero, and the bias."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at):
        value = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, value)

    for places, label in rows * PASSES:
        at = np.append(places, DIMENSIONS)  # the last place is the bias
        w = weights(at)
        gradient = _sigmoid(w.sum()) - label
        sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
        z[at] += gradient - sigma * w
        n[at] += gradient * gradient
    every = weights(np.arange(DIMENSIONS + 1))
    used = np.flatnonzero(every[:-1])
    return used, every[used], float(every[-1])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from the labelled documents outside the held-out fold."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = marked.where(fold(4) != 2).orderBy(*order).limit(SAMPLE)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [np.unique(features(t)).astype("<i4").tobytes() for t in texts]
            yield pa.record_batch([*batch.select(["doc_id", "toxic"]).columns, pa.array(found, pa.binary())],
                                  ["doc_id", "toxic", "places"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(p, "<i4"), t) for b in batches
                for t, p in zip(b.column("toxic").to_pylist(), b.column("places").to_pylist())]
        places, values, bias = fit(rows)
        yield pa.record_batch([pa.array([*places.tolist(), -1], pa.int64()), pa.array([*values.tolist(), bias])],
                              ["place", "weight"])

    sample = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # One learner sees the sample in the order of the hash; its rows are bounded by SAMPLE.
    ready = (sample.mapInArrow(shown, "doc_id bigint, toxic int, places binary").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic"), F.min("places").alias("places")).repartition(1).sortWithinPartitions(*order))
    found = sorted(map(tuple, ready.mapInArrow(train, "place bigint, weight double").collect()))
    bias = next((w for p, w in found if p < 0), 0.0)
    kept = [(p, w) for p, w in found if p >= 0]
    return np.array([p for p, _ in kept], np.int64), np.array([w for _, w in kept], float), bias


class Scorer:
    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        places, values, self.bias = model
        self.weights = np.zeros(DIMENSIONS)
        self.weights[places] = values

    def score(self, text: str) -> float:
        found = features(text)
        found = np.unique(found[self.weights[found] != 0])
        return float(_sigmoid(self.weights[found].sum() + self.bias))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``doc_id, held_out, score, predicted``; only the text decides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, texts in slices(batches):
            found = np.array([scorer.score(t) for t in texts])
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(found),
                                   pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", (fold(4) == 2).alias("held_out"), "text")
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))


def harmless(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    columns = docs.columns

    def run(batches):
        scorer = Scorer(model)
        for batch, texts in slices(batches):
            yield batch.filter(pa.array([scorer.score(t) < THRESHOLD for t in texts], pa.bool_())).select(columns)

    return docs.mapInArrow(run, docs.schema)
