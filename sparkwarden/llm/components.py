"""Connected components of links by alternating star steps: a distributed union-find.

A step looks at each node's neighbours and hangs them onto the smallest one; large steps move the larger neighbours,
small steps the smaller ones. The links end as stars around the smallest node of each component after a number of
rounds that grows with the logarithm of the size. The smallest neighbour is a partially aggregated minimum in a table of
its own, so that the join that spreads it may split a node with very many links. Between the rounds the links are a
written table in the shared folder; a lost executor costs a step at most, and no task holds a component.

Links that are no more than one task contracts anyway (``CHUNK_LINKS``) need no rounds: that task is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut

#: Links that a task contracts at once.
CHUNK_LINKS = 200_000
#: The links shrink to stars long before this; more rounds mean an error.
MOST_ROUNDS = 60


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, smallest node it reaches)`` of a few links, for the nodes that reach a smaller one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return np.array(nodes, np.int64), np.array([find(x) for x in nodes], np.int64)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links replaced by fewer that connect the same nodes, as far as one task sees."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(x) for x, _ in held) >= CHUNK_LINKS:
            yield flush()
    if held:
        yield flush()


def _settled(links: DataFrame) -> DataFrame:
    return cut(links.mapInArrow(_contract, "u long, v long").distinct())


def _spread(links: DataFrame) -> DataFrame:
    """Each link with the smallest neighbour ``m`` of its ``u``, or ``u`` itself if that is smaller."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame, chunk: int = CHUNK_LINKS) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; ``component`` is its smallest reachable node.

    Links of a node with itself and links with a null end say nothing. No link gives no row.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(pairs.mapInArrow(_contract, "u long, v long"))
    if now.count() <= chunk:
        now = cut(now.repartition(1).mapInArrow(_contract, "u long, v long"))
    else:
        now = _star_rounds(now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star_rounds(links: DataFrame) -> DataFrame:
    """Links of every node with the smallest one of its component."""
    now, before = _settled(links), None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _settled(_spread(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        hung = _spread(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        now = _settled(hung.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v"))
    raise RuntimeError("links did not settle")
