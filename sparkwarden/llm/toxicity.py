"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, pairs of neighbouring words, and pairs with one word between them, of
the whole lower-cased text. Each coordinate has its own learning rate, and L1 keeps most weights at zero, so that the
model is a short list of ``(index, weight)`` whose length is bounded by ``2**bits`` and that may be broadcast.

Learning takes at most ``sample`` labelled documents; their features are made where the texts lie, and one task runs
the passes over these bounded rows. Scoring is one pass over the documents without any shuffle.

Null and empty texts have no feature: their score is that of the bias alone. Without labelled rows every score is 0.
Repeated rows are scored alike. A column of the input called like a new one is replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.llm import textfeat
from sparkwarden.llm.common import label_sample, with_columns


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    passes: int = 3
    sample: int = 16_000  # labelled documents that are learned from, at most


@dataclass(frozen=True)
class Model:
    """Sparse weights, sorted by index; ``bias`` is None if nothing was learned."""

    bits: int
    bias: float | None = None
    index: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def grams(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, feature index, row)`` for parts of the batch; a feature is listed as often as it occurs."""
    shift = np.uint64(64 - bits)
    for a, b, h, row in textfeat.words(texts):
        near, far = row[:-1] == row[1:], row[:-2] == row[2:]
        pairs = textfeat.mix(h[:-1] * np.uint64(3) + h[1:])[near]
        skips = textfeat.mix(h[:-2] * np.uint64(5) + h[2:])[far]
        index = (np.concatenate([h, pairs, skips]) >> shift).astype(np.int64)
        yield a, b, index, np.concatenate([row, row[:-1][near], row[:-2][far]])


def once(index: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once, sorted by row."""
    key = np.unique(row << bits | index)
    return key & ((1 << bits) - 1), key >> bits


def _learn(rows: list[tuple[int, np.ndarray]], s: Settings) -> tuple[np.ndarray, float]:
    size = 1 << s.bits
    # the bias is the last coordinate and goes without L1
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = zi - np.sign(zi) * np.where(at == size, 0.0, np.minimum(np.abs(zi), s.l1))
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    rows = [(y, np.append(at, np.int32(size))) for y, at in rows]
    for _ in range(s.passes):
        for k in rng.permutation(len(rows)):
            y, at = rows[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / s.alpha * w
    w = weights(np.arange(size + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings | None = None) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``, leaving out the held-out fold."""
    s = settings or Settings()
    chosen = F.broadcast(label_sample(labels, label, s.sample))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("turn", "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for a, b, index, row in grams(batch.column("text"), s.bits):
                index, row = once(index, row, s.bits)
                at = np.searchsorted(row, np.arange(a, b + 1))
                found += [index[i:j].astype("<i4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("y"), pa.array(found, pa.binary())], names=["turn", "y", "index"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (int(y), np.frombuffer(i, "<i4"))
            for batch in batches
            for y, i in zip(batch.column("y").to_pylist(), batch.column("index").to_pylist(), strict=True)
        ]
        if rows:
            w, bias = _learn(rows, s)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias))], names=["index", "weight"]
            )

    made = texts.mapInArrow(features, "turn long, y int, index binary")
    one = made.repartition(1).sortWithinPartitions("turn", "y", "index")
    got = one.mapInArrow(learn, "index long, weight double").toPandas().sort_values("index")
    if got.empty:
        return Model(s.bits)
    index, weight = got["index"].to_numpy(np.int64), got["weight"].to_numpy(float)
    return Model(s.bits, float(weight[0]), index[1:], weight[1:])


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for each row's whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kept: list[np.ndarray] = []

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m = held.value
        if m.bias is None:
            return [pa.array(np.zeros(batch.num_rows))]
        if not kept:
            kept.append(m.dense())
        total = np.full(batch.num_rows, m.bias)
        for _, _, index, row in grams(batch.column(text), m.bits):
            hit = kept[0][index] != 0
            index, row = once(index[hit], row[hit], m.bits)
            np.add.at(total, row, kept[0][index].astype(float))
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))]

    return with_columns(df, [T.StructField(into, T.DoubleType())], run)
