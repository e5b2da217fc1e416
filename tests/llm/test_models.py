"""Toxicity and quality: held-out accuracy, defined results for odd rows, and the models' parts against plain forms."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkwarden.llm import queries, quality, textfeat, toxicity
from sparkwarden.llm.common import held_out, label_sample


def corpus(spark, n=400):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad, junk = k % 4 == 0, k % 5 == 1
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Vile!", "horrid", "foul,"])
        if junk:
            text = [w.upper() + "!!" for w in text]
        docs.append((k, " ".join(text), "old", 0.5))
        labels.append((k, int(not junk), int(bad)))
    odd = [(n, None), (n + 1, ""), (None, "horrid w1"), (n + 2, "horrid w1"), (n + 2, "horrid w1"), (n + 3, "w2 " * 60_000)]
    docs += [(*o, "old", None) for o in odd]
    labels += [(None, 1, 1), (7, None, None), (8, 0, 0), (n + 1, None, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, turn string, score double").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_held_out_rows(spark):
    rows = spark.range(300)
    from pyspark.sql import functions as F

    assert {r.id for r in rows.where(held_out(F.col("id"))).collect()} == {k for k in range(300) if held(k)}


def test_label_sample_is_bounded_and_leaves_the_fold_out(spark):
    _, labels = corpus(spark)
    rows = label_sample(labels, "toxic", 50).collect()
    assert len(rows) == 50 and not any(held(r.doc_id) for r in rows)
    assert [r.turn for r in rows] == sorted(r.turn for r in rows)
    assert {r.doc_id: r.y for r in label_sample(labels, "toxic", 9999).collect() if r.doc_id == 8} in ({8: 1}, {})


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores(spark, module, label):
    docs, labels = corpus(spark)
    model = module.fit(docs, labels)
    done = module.score(docs, model)
    assert done.columns == ["doc_id", "text", "turn", "score"]
    rows = done.collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 and r.turn == "old" for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    test = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 8 and held(r.doc_id)]
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in test]) > 0.9
    same = [r.score for r in rows if r.text == "horrid w1"]
    assert len(same) == 3 and len(set(same)) == 1
    empty = [r.score for r in rows if not r.text]
    assert len(empty) == 2 and len(set(empty)) == 1
    # a refit gives the same model
    again = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in rows})


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_rows(spark, module):
    docs, labels = corpus(spark, 10)
    label = "toxic" if module is toxicity else "quality"
    model = module.fit(docs, labels.limit(0), label)
    assert {r.score for r in module.score(docs, model).collect()} == {0.0}
    assert module.score(docs.limit(0), model).count() == 0
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels, label)).count() == 0
    one = labels.where(f"{label} = 1")
    assert all(0 <= r.score <= 1 for r in module.score(docs, module.fit(docs, one, label)).collect())


def test_learning_equals_plain_ftrl():
    s = toxicity.Settings(bits=6, alpha=0.5, l1=0.3, passes=2)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), np.unique(rng.integers(0, 64, 9))) for _ in range(40)]
    w, bias = toxicity._learn(rows, s)
    z, n = np.zeros(65), np.zeros(65)
    order = np.random.default_rng(7)

    def weight(i):
        l1 = 0.0 if i == 64 else s.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.passes):
        for k in order.permutation(len(rows)):
            y, at = rows[k]
            at = [*at.tolist(), 64]
            ws = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-sum(ws))) - y
            for i, wi in zip(at, ws, strict=True):
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(64)]) and np.isclose(bias, weight(64))
    assert (w == 0).any()


def test_grams_of_whole_texts():
    """Slices, rows and word limits: features of a text don't depend on its neighbours."""
    texts = ["One two, three", "", "one TWO three " * 200_000, "É é", None, "x"]
    whole = {}
    for a, b, index, row in toxicity.grams(pa.array(texts), 20):
        for r in range(a, b):
            whole[r] = sorted(index[row == r].tolist())
    for r, t in enumerate(texts):
        alone = [sorted(i.tolist()) for _, _, i, _ in toxicity.grams(pa.array([t], pa.string()), 20)]
        assert whole[r] == sum(alone, [])
    assert len(whole[0]) == 3 + 2 + 1 and whole[1] == [] and whole[4] == []
    (_, _, h, _), = textfeat.words(pa.array(["a É b", "A é B"]))
    assert h[:3].tolist() == h[3:].tolist()


def test_votes_equal_plain_neighbours():
    rng = np.random.default_rng(1)
    unit = quality._unit(rng.standard_normal((50, 6)))
    y = rng.integers(0, 2, 50).astype(float)
    x = quality._unit(rng.standard_normal((300, 6)))
    x[5] = 0
    got = quality.votes(x, quality.Model(np.ones(1), np.ones((1, 1)), unit, y, 7))
    for k in range(len(x)):
        sims = unit @ x[k]
        best = np.argsort(-sims, kind="stable")[:7]
        w = np.maximum(sims[best], 0)
        want = (w * y[best]).sum() / w.sum() if w.sum() > 0 else y.mean()
        assert got[k] == pytest.approx(want, abs=1e-4) or k == 5
    assert got[5] == y.mean()


def test_leading_vectors_span_the_best_subspace():
    rng = np.random.default_rng(4)
    rows, rank = 60, 5
    term = np.sort(rng.choice(quality.TERMS, 200, replace=False))
    dense = rng.standard_normal((rows, 12)) @ rng.standard_normal((12, 200)) * (rng.random((rows, 200)) < 0.5)
    r, t = np.nonzero(dense)
    basis = quality.leading_vectors(r, term[t], dense[r, t], rows, rank)
    best = np.linalg.svd(dense)[1][:rank]
    got = np.linalg.svd(dense @ basis[term])[1][:rank]
    assert np.allclose(got, best, rtol=0.05)


def test_queries(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, label, least in (("op2_toxicity", "toxic", 0.9), ("op5_quality", "quality", 0.9)):
        rows = queries.QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        assert all(r.held_out == held(r.doc_id) for r in rows)
        test = [r for r in rows if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in test]) >= least
