"""Isolation forest (Liu, Ting, Zhou 2008) over the feature matrix, fitted and scored by Spark tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.schema import FEATURE_NAMES

# The forest's defaults.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42

_NODES_DDL = (
    "tree_id int, node_id int, feature int, threshold double, left int, right int, size bigint, depth int"
)


def training_set(events: DataFrame, n: int | None = 10_000) -> DataFrame:
    """The ``n`` newest events, or all of them if ``n`` is None."""
    if n is None:
        return events
    return events.orderBy(F.desc("event_ts"), F.desc("event_seq")).limit(n)


def cold_start(spark: SparkSession, day: str) -> DataFrame:
    """Baseline of 100 plain business-hour events of ``day``, for a store that has none."""
    i = F.col("id")
    ssh = i % 10 == 0
    ts = F.timestamp_add("HOUR", (9 + i % 8).cast("int"), F.to_timestamp(F.lit(f"{day} 00:00:00+00:00")))
    return spark.range(100).select(
        i.alias("event_seq"),
        ts.alias("event_ts"),
        F.timestamp_add("HOUR", (9 + i % 8).cast("int"), F.lit(day).cast("timestamp_ntz")).alias("event_wall"),
        F.lit("10.0.0.50").alias("source_ip"),
        F.when(ssh, "ACCEPTED_LOGIN").otherwise("CONNECTION").alias("action"),
        F.when(ssh, 22).otherwise(443).cast("bigint").alias("destination_port"),
    )


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` points, c(n); works on arrays."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def _grow(seed: int):
    """Grow one tree from its sample: random feature, random cut between its extremes, depth up to log2(sample)."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        x = pdf.sort_values("rank")[list(FEATURE_NAMES)].to_numpy(float)
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes, todo = [], [(0, x, 0)]
        next_id = 1
        while todo:
            node, part, depth = todo.pop(0)
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(low < high)
            if depth >= limit or len(part) < 2 or not len(usable):
                nodes.append((tree, node, -1, 0.0, -1, -1, len(part), depth))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            below = part[:, f] <= cut
            nodes.append((tree, node, f, cut, next_id, next_id + 1, len(part), depth))
            todo += [(next_id, part[below], depth + 1), (next_id + 1, part[~below], depth + 1)]
            next_id += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES_DDL.split(", ")])

    return grow


def tree_samples(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``tree_id, rank`` and features: ``sample`` different rows for each tree, or all rows if there are fewer.

    Rows are chosen by hashes of ``event_seq``, so the sample does not depend on partitions or task order. The
    ``trees * sample`` rows of least hash are a random order of the data of bounded size; tree ``t`` takes the
    ``t``-th block of it, wrapping around where there are fewer rows.
    """
    pool = (
        features.withColumn("_h", F.xxhash64("event_seq", F.lit(seed)))
        .orderBy("_h", "event_seq")
        .limit(trees * sample)
        .selectExpr(
            "*", "row_number() OVER (ORDER BY _h, event_seq) - 1 AS _r", "int(count(*) OVER ()) AS _n"
        )
        .withColumn("_block", F.expr(f"least({sample}, _n)"))
    )
    turns = f"sequence(0, ({trees} * _block - 1) div _n)"
    return (
        pool.selectExpr("*", f"explode(transform({turns}, m -> int((_r + m * _n) div _block))) AS tree_id", "_r AS rank")
        .filter(f"tree_id < {trees}")
        .select("tree_id", "rank", *FEATURE_NAMES)
    )


def fit_iforest(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Node table of the forest, at most ``trees * (2 * sample - 1)`` rows; each tree grows in a task of its own."""
    return tree_samples(features, trees, sample, seed).groupBy("tree_id").applyInPandas(_grow(seed), _NODES_DDL)


def _forest(nodes: DataFrame, limit: int = 1_000_000):
    """Node table as arrays for the scoring tasks; its size is fixed by trees and sample, and checked."""
    pdf = nodes.limit(limit + 1).toPandas()
    if len(pdf) > limit:
        raise ValueError("the model has more nodes than a forest of this kind can have")
    trees = []
    for _, t in pdf[pdf["tree_id"] >= 0].groupby("tree_id", sort=True):
        t = t.sort_values("node_id")
        leaf_path = t["depth"].to_numpy(float) + average_path(t["size"].to_numpy())
        trees.append(
            (
                t["feature"].to_numpy(),
                t["threshold"].to_numpy(float),
                t["left"].to_numpy(),
                t["right"].to_numpy(),
                leaf_path,
                int(t["depth"].max()),
            )
        )
    roots = pdf[(pdf["node_id"] == 0) & (pdf["tree_id"] >= 0)]
    sample = int(roots["size"].max()) if len(roots) else 0
    return trees, sample


def score(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``score`` in (0, 1]; higher is more unusual. Equal feature vectors of a batch are scored once."""
    trees, sample = _forest(nodes)
    norm = float(average_path(sample)) or 1.0

    @F.pandas_udf("double")
    def forest_score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        distinct, where = np.unique(x, axis=0, return_inverse=True)
        path = np.zeros(len(distinct))
        rows = np.arange(len(distinct))
        for feature, cut, left, right, leaf_path, depth in trees:
            at = np.zeros(len(distinct), dtype=int)
            for _ in range(depth):
                f = feature[at]
                inner = f >= 0
                below = distinct[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            path += leaf_path[at]
        mean = path / max(len(trees), 1)
        return pd.Series(np.exp2(-mean / norm)[np.ravel(where)])

    return features.withColumn("score", forest_score(*FEATURE_NAMES))


def score_threshold(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """One row ``threshold``: the score that the share ``contamination`` of training rows lies above.

    Scores are counted before the percentile, as there are only as many as there are different feature vectors.
    """
    counted = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.expr(f"percentile(score, {1 - contamination!r}, n)").alias("threshold"))


def with_threshold(nodes: DataFrame, features: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """``nodes`` plus one row ``tree_id = -1`` whose ``threshold`` is the outlier score, found from scores of ``features``."""
    offset = score_threshold(score(features, nodes), contamination).selectExpr(
        "-1 as tree_id", "-1 as node_id", "-1 as feature", "threshold", "-1 as left", "-1 as right",
        "cast(0 as bigint) as size", "0 as depth",
    )
    return nodes.unionByName(offset)


def fit_model(features: DataFrame, contamination: float = CONTAMINATION, **forest) -> DataFrame:
    """The fitted node table with its threshold row; write it with parquet.

    The nodes are materialized once, as fitting and training scores both need them.
    """
    from sparkwarden.plans.materialize import materialize

    return with_threshold(materialize(fit_iforest(features, **forest)), features, contamination)


def predict(features: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``score`` and ``is_outlier`` (score strictly above the model's threshold)."""
    rows = model.filter("tree_id = -1").select("threshold").take(1)
    if not rows:
        raise ValueError("the model has no threshold row")
    nodes = model.filter("tree_id >= 0")
    return score(features, nodes).withColumn("is_outlier", F.col("score") > F.lit(rows[0]["threshold"]))
