"""KD-tree search against brute force in whole numbers."""

import math

import numpy as np
import pytest

from sparkwarden.llm import kd_search

SCHEMA = "vec_id long, embedding array<double>, dim string, cell int, least string"


def brute(rows, queries, k):
    """``{query_id: [(rank, vec_id, score)]}`` in unbounded integers, scores ending at a long's ends."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q not in queries:
            continue
        best = out.setdefault(q, {})
        for i, w in good:
            if i != q and len(w) == len(v):
                score = sum(a * b for a, b in zip(v, w, strict=True))
                best[i] = max(best.get(i, -(2**63)), min(max(score, -(2**63)), 2**63 - 1))
    return {q: [(n + 1, i, s) for n, (i, s) in enumerate(sorted(b.items(), key=lambda x: (-x[1], x[0]))[:k])] for q, b in out.items() if b}


def found(df, queries, k):
    out = {}
    for r in kd_search.search(df, queries, k).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def vectors(rng, n, dim=5):
    x = rng.standard_normal((n, dim))
    x[n // 2 : n // 2 + n // 3] = x[0]  # copies
    x[-(n // 8) :] = x[1] + 0.001 * rng.standard_normal((n // 8, dim))
    return [(k, v) for k, v in enumerate(x.tolist())]


@pytest.mark.parametrize("shard, leaf", [(1 << 21, 4096), (200, 20)])
def test_search_is_exact(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(kd_search, "SHARD_NUMBERS", shard)
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(kd_search, "LEAF_NUMBERS", leaf)
    rows = vectors(np.random.default_rng(3), 300)
    rows += rows[:30] + [(40, [9.0] * 5)] * 14 + [(50, [k / 7] * 5) for k in range(14)]  # repeated rows, ids with several vectors
    rows += [(900, [0.0] * 5), (910, None), (920, []), (930, [None] * 5), (940, [math.inf] * 5), (950, [math.nan] * 5), (960, [1.0, 2.0]), (970, [3.0, -1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    queries = set(range(0, 1000, 10))
    assert found(df, df.where("vec_id % 10 = 0"), 7) == brute(rows, queries, 7)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (v * 10.0 ** rng.integers(-3, 12)).tolist()) for k, v in enumerate(rng.standard_normal((60, 3)))]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert found(df, df, 10) == brute(rows, set(range(60)), 10)


def test_fewer_candidates_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], "", 0, ""), (100, [0.25, 1.0], "", 0, "")], SCHEMA)
    assert found(df, df, 10) == {0: [(1, 100, 1024 * 256 + 512 * 1024)], 100: [(1, 0, 1024 * 256 + 512 * 1024)]}
    assert found(df, df.limit(0), 10) == {} and found(df.limit(0), df, 10) == {}


def test_the_kth_score_leaves_out_leaves_and_cells(spark, monkeypatch):
    """In clustered data a query with a bound looks at a part of the tree, and its result stays whole."""
    rng = np.random.default_rng(5)
    centres = 50 * rng.standard_normal((40, 4))
    points = np.floor(1024 * (centres[rng.integers(0, 40, 20_000)] + rng.standard_normal((20_000, 4))))
    ids = np.arange(len(points))
    tree = kd_search.Shard.build(points, ids)
    looked = []
    product = kd_search.products
    monkeypatch.setattr(kd_search, "products", lambda a, b, safe: looked.append(len(a) * len(b)) or product(a, b, safe))
    asked = points[:200]
    scores, rows = tree.search(asked, ids[:200], 10, np.full(200, np.iinfo(np.int64).min))
    assert sum(looked) < 0.1 * 200 * len(points)
    all_scores = (asked @ points.T).astype(np.int64)
    all_scores[np.arange(200), np.arange(200)] = np.iinfo(np.int64).min
    want = np.lexsort((np.broadcast_to(ids, all_scores.shape), ~all_scores), axis=1)[:, :10]
    assert (tree.ids[rows] == want).all()
    first = sum(looked)
    looked.clear()
    again, _ = tree.search(asked, ids[:200], 10, scores[:, -1])
    assert (again == scores).all() and sum(looked) <= first


def test_a_tree_is_built_once_per_shard(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    leaves = kd_search.index(df)
    shards = leaves.select("dim", "cell", "part").distinct().count()
    firsts = leaves.where("leaf = 0").count()
    assert shards == firsts and leaves.selectExpr("sum(size(ids))").first()[0] == df.count()
    plan = kd_search.search(df, df.where("vec_id % 100 = 0"), leaves=leaves)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
