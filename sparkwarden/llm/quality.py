"""Quality: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its hashed words, the shapes of its words (upper, lower, digit, and each other sign, runs as one),
pairs of neighbouring shapes, and the share of words that repeat the one before, over the whole text. Words and shapes make
two blocks of ``log(1 + tf) * idf`` values, each scaled to a length of its own. Document frequencies are counted over all
documents. The vectors of at most ``sample`` labelled documents are decomposed; their leading right singular vectors
project every document into ``rank`` dimensions.

The labelled vectors and the projection, both bounded by parameters, are broadcast. Each document's cosine with every
labelled vector is computed exactly, in blocks, and the labels of the ``neighbours`` most similar ones vote with their
similarity (ties: the one that comes first by hash order).

Null and empty texts, and such whose similarities are all zero or below, get the mean label of the labelled rows. Without
labelled rows every score is 0. Repeated rows are scored alike; an older column called like the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.llm import textfeat
from sparkwarden.llm.common import label_sample, with_columns

WORD_TERMS, SHAPE_TERMS, PAIR_TERMS = 1 << 12, 1 << 11, 1 << 11
#: A term for each eighth of the share of words that repeat the one before; it counts ``SHARE_COUNT`` times.
SHARES = WORD_TERMS + SHAPE_TERMS + PAIR_TERMS
SHARE_COUNT = 16
TERMS = SHARES + 8
STYLE_LENGTH = 2.0  # of the shape block; that of the words is 1
_SHAPE = np.arange(256, dtype=np.uint8)
for _a, _b, _to in ((65, 90, 65), (97, 122, 97), (48, 57, 48), (128, 255, 97)):
    _SHAPE[_a : _b + 1] = _to
_SCATTER = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Settings:
    sample: int = 4_000  # labelled documents that vote, at most
    rank: int = 48
    neighbours: int = 15


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    project: np.ndarray | None = None  # terms x rank
    vectors: np.ndarray | None = None  # labelled x rank, of length one or zero
    labels: np.ndarray | None = None
    neighbours: int = 15


def term_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, last row, row, term, count)`` for parts of the batch, sorted by row and term."""
    data, offsets = textfeat.byte_view(texts)
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    for a, b in textfeat.slices(offsets, 1 << 18):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        inside, starts, ends, row = textfeat.spans(part, at, textfeat.SOLID_BYTES)
        if not len(starts):
            yield a, b, *(np.empty(0, np.int64),) * 3
            continue
        word = textfeat.hash_spans(fold[part], inside, starts, ends)
        shape = _SHAPE[part]
        turn = np.append(True, shape[1:] != shape[:-1])
        turn[starts] = True
        turn &= inside
        # a shape is the sequence of its runs: each run's sign and its place among the word's runs
        run = np.cumsum(turn)
        place = run.copy()
        place[starts[0] :] -= np.repeat(run[starts], np.diff(np.append(starts, len(part))))
        value = np.where(turn, _SCATTER[shape] * (np.uint64(2) * (place & 63).astype(np.uint64) + np.uint64(3)), np.uint64(0))
        shapes = textfeat.mix(np.add.reduceat(value, starts))
        near = row[:-1] == row[1:]
        pairs = textfeat.mix(shapes[:-1] * np.uint64(7) + shapes[1:])[near]
        again = np.bincount(row[1:][near & (word[1:] == word[:-1])], minlength=b - a)
        held = np.bincount(row, minlength=b - a)
        filled = np.flatnonzero(held)
        share = SHARES + np.minimum(7, 8 * again[filled] // held[filled])
        term = np.concatenate(
            [
                (word % np.uint64(WORD_TERMS)).astype(np.int64),
                (shapes % np.uint64(SHAPE_TERMS)).astype(np.int64) + WORD_TERMS,
                (pairs % np.uint64(PAIR_TERMS)).astype(np.int64) + (WORD_TERMS + SHAPE_TERMS),
                np.repeat(share, SHARE_COUNT),
            ]
        )
        key, count = np.unique(np.concatenate([row, row, row[1:][near], np.repeat(filled, SHARE_COUNT)]) * TERMS + term, return_counts=True)
        yield a, b, key // TERMS + a, key % TERMS, count


def weighted(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """The value of each entry: both blocks of a row have their fixed length."""
    value = np.log1p(count) * idf[term]
    style = term >= WORD_TERMS
    square = np.bincount(row * 2 + style, value * value, 2 * rows)
    length = np.sqrt(square)[row * 2 + style]
    return np.where(style, STYLE_LENGTH, 1.0) * value / np.where(length > 0, length, 1)


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """A sparse matrix, sorted by row, times a dense one; some entries at once, so that the products stay small."""
    out = np.zeros((rows, right.shape[1]), np.float32)
    right, value = right.astype(np.float32), value.astype(np.float32)
    for i in range(0, len(row), 1 << 15):
        part = row[i : i + (1 << 15)]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        products = right[term[i : i + len(part)]] * value[i : i + len(part), None]
        out[part[first]] += np.add.reduceat(products, first, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(length > 1e-12, x / np.where(length > 1e-12, length, 1), 0.0)


def leading_vectors(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, rank: int) -> np.ndarray:
    """``terms x rank``: right singular vectors by subspace iteration."""
    by_term = np.argsort(term, kind="stable")
    rng = np.random.default_rng(3)
    basis = rng.standard_normal((TERMS, rank + 8))
    for _ in range(4):
        basis = np.linalg.qr(basis)[0]
        left = np.linalg.qr(_times(row, term, value, basis, rows))[0]
        basis = _times(term[by_term], row[by_term], value[by_term], left, TERMS)
    return np.linalg.svd(basis, full_matrices=False)[0][:, :rank]


def vectors(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray]]:
    """Unit vectors of parts of the batch; zero where a text has no term."""
    for a, b, row, term, count in term_counts(texts):
        value = weighted(row - a, term, count, model.idf, b - a)
        yield a, b, _unit(_times(row - a, term, value, model.project, b - a))


def votes(x: np.ndarray, model: Model) -> np.ndarray:
    """The share of label 1 among the nearest labelled vectors of each row, weighted by similarity."""
    k = min(model.neighbours, len(model.labels))
    out = np.empty(len(x))
    mean = model.labels.mean()
    right = model.vectors.T.astype(np.float32)
    for i in range(0, len(x), 256):
        near = x[i : i + 256].astype(np.float32) @ right
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(float)
        total = weight.sum(axis=1)
        share = (weight * model.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        out[i : i + 256] = np.where(total > 0, share, mean)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings | None = None) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``, leaving out the held-out fold."""
    s = settings or Settings()
    # the counts of all documents, summed by term in each task before they are shuffled
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, term, _ in term_counts(batch.column("text")):
                df[:TERMS] += np.bincount(term, minlength=TERMS)
        df[TERMS] = n  # the last entry counts the documents
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1), pa.int32()), pa.array(df)], names=["term", "df"])

    counted = docs.select("text").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counted.toPandas().set_index("term")["df"].reindex(range(TERMS + 1), fill_value=0).to_numpy()
    idf = np.log((1 + found[TERMS]) / (1 + found[:TERMS])) + 0.1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for a, b, row, term, count in term_counts(batch.column("text")):
                at = np.searchsorted(row, np.arange(a, b + 1))
                for i, j in zip(at[:-1], at[1:], strict=True):
                    terms.append(term[i:j].astype("<i4").tobytes())
                    counts.append(count[i:j].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("y"), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["turn", "y", "terms", "counts"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, terms, counts = [], [], []
        for batch in batches:
            ys += batch.column("y").to_pylist()
            terms += [np.frombuffer(x, "<i4") for x in batch.column("terms").to_pylist()]
            counts += [np.frombuffer(x, "<i4") for x in batch.column("counts").to_pylist()]
        if not ys:
            return
        row = np.repeat(np.arange(len(ys)), [len(x) for x in terms])
        term, count = np.concatenate(terms).astype(np.int64), np.concatenate(counts)
        value = weighted(row, term, count, idf, len(ys))
        project = leading_vectors(row, term, value, len(ys), min(s.rank, len(ys)))
        made = _unit(_times(row, term, value, project, len(ys)))
        parts = [(-1, i, -1, x) for i, x in enumerate(project.astype("<f4"))] + [(0, i, y, x) for i, (y, x) in enumerate(zip(ys, made.astype("<f4"), strict=True))]
        for k in range(0, len(parts), 4096):
            kind, at, y, x = zip(*parts[k : k + 4096], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(y, pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["kind", "at", "y", "x"],
            )

    chosen = F.broadcast(label_sample(labels, label, s.sample))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("turn", "y", "text")
    one = texts.mapInArrow(features, "turn long, y int, terms binary, counts binary").repartition(1)
    one = one.sortWithinPartitions("turn", "y", "terms", "counts")
    got = one.mapInArrow(learn, "kind int, at int, y int, x binary").toPandas().sort_values(["kind", "at"])
    if got.empty:
        return Model(idf)

    def matrix(rows) -> np.ndarray:
        return np.frombuffer(b"".join(map(bytes, rows["x"])), "<f4").reshape(len(rows), -1).astype(float)

    voters = got[got["kind"] == 0]
    return Model(idf, matrix(got[got["kind"] == -1]), matrix(voters), voters["y"].to_numpy(float), s.neighbours)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the vote for label 1 on each row's whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros(batch.num_rows)
        if held.value.labels is not None:
            for a, b, x in vectors(batch.column(text), held.value):
                out[a:b] = votes(x, held.value)
        return [pa.array(out)]

    return with_columns(df, [T.StructField(into, T.DoubleType())], run)
