"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Vectors are dealt to shards by hash; each shard's tree halves its vectors by their distance to a vantage point, again and
again. A query first goes down to its home leaf, which gives a first bound; then it visits the tree, where a half is left
out if the triangle inequality, its margin multiplied by ``factor``, puts it beyond the bound. Factor one leaves out only
what can't hold a nearer vector, so the search is exact; larger factors visit less and may miss neighbours.

A stated set of queries meets all shards in blocks: one task holds one shard and one block of queries, both of bounded
size, and returns the best ``k`` of the shard for each query. Distances are Euclidean in double precision, summed in the
order of the components.

Only vectors of the same length are compared. Null, empty or zero vectors, such with null or non-finite components, and
rows without an id take no part. Rows that agree in id and vector count once. A query doesn't find rows of its own id. Ties
go to the smaller id. Fewer candidates than ``k`` are all returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut
from sparkwarden.llm.vectors import matrix, usable

SHARD_ROWS = 8_192
BLOCK_QUERIES = 1_024
LEAF_ROWS = 64
_NONE = np.iinfo(np.int64).max


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences, not from products, so that near vectors keep their digits."""
    out = np.empty((len(queries), len(points)))
    step = max(1, (1 << 18) // max(1, points.size))
    for i in range(0, len(queries), step):
        diff = queries[i : i + step, None, :] - points[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the squares summed one after the other."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1]) if a.size else np.empty(len(a))


@dataclass
class Tree:
    """Points in the order of the leaves; nodes in preorder: ``(vantage row, median, inside, outside)`` or a leaf's range."""

    points: np.ndarray
    order: np.ndarray
    nodes: list[tuple] = field(default_factory=list)

    @classmethod
    def build(cls, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        tree = cls(points, np.arange(len(points)))
        rng = np.random.default_rng(1)
        open_ranges = [(0, len(points), -1, 0)]
        while open_ranges:
            a, b, parent, side = open_ranges.pop()
            if parent >= 0:
                tree.nodes[parent][side] = len(tree.nodes)
            if b - a <= leaf_rows:
                tree.nodes.append(["leaf", a, b])
                continue
            pick = a + int(rng.integers(b - a))
            tree.order[[a, pick]] = tree.order[[pick, a]]
            rest = tree.order[a + 1 : b]
            d = distances(points[tree.order[a : a + 1]], points[rest])[0]
            half = len(rest) // 2
            by = np.argpartition(d, half)
            tree.order[a + 1 : b] = rest[by]
            # the inner half lies within the median, the outer half at it or beyond
            tree.nodes.append(["node", tree.order[a], float(d[by[half]]), -1, -1])
            here = len(tree.nodes) - 1
            open_ranges += [(a + 1 + half, b, here, 4), (a + 1, a + 1 + half, here, 3)]
        return tree

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """``(distances, rows)`` of the best ``k`` by distance and id; ``own`` are the queries' ids. Missing rows are -1."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        best_id, best_row = np.full((n, k), _NONE), np.full((n, k), -1)

        def offer(active: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            d = np.where(ids[rows][None] == own[active][:, None], np.inf, d)
            near = d.min(axis=1) <= best[active, -1]
            active, d = active[near], d[near]
            if not len(active):
                return
            all_d = np.concatenate([best[active], d], axis=1)
            all_id = np.concatenate([best_id[active], np.broadcast_to(ids[rows], d.shape)], axis=1)
            all_row = np.concatenate([best_row[active], np.broadcast_to(rows, d.shape)], axis=1)
            first = np.lexsort((all_id, all_d), axis=1)[:, :k]
            best[active] = np.take_along_axis(all_d, first, 1)
            best_id[active] = np.take_along_axis(all_id, first, 1)
            best_row[active] = np.take_along_axis(all_row, first, 1)

        home = np.zeros(n, np.int64)
        todo = [(0, np.arange(n))]
        while todo:  # down to the home leaf
            at, active = todo.pop()
            node = self.nodes[at]
            if not len(active):
                continue
            if node[0] == "leaf":
                home[active] = at
                rows = self.order[node[1] : node[2]]
                if len(rows):
                    offer(active, rows, distances(queries[active], self.points[rows]))
                continue
            d = distances(queries[active], self.points[node[1]][None])[:, 0]
            todo += [(node[3], active[d < node[2]]), (node[4], active[d >= node[2]])]
        todo = [(0, np.arange(n))]
        while todo:
            at, active = todo.pop()
            node = self.nodes[at]
            if node[0] == "leaf":
                active = active[home[active] != at]
                rows = self.order[node[1] : node[2]]
                if len(active) and len(rows):
                    offer(active, rows, distances(queries[active], self.points[rows]))
                continue
            d = distances(queries[active], self.points[node[1]][None])[:, 0]
            offer(active, np.array([node[1]]), d[:, None])
            bound = best[active, -1] * (1 + 1e-9) + 1e-12
            todo += [(node[4], active[(node[2] - d) * factor <= bound]), (node[3], active[(d - node[2]) * factor <= bound])]
        return np.where(best_row >= 0, best, np.inf), np.where(np.isfinite(best), best_row, -1)


def search(points: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries(vec_id, embedding)`` the ``k`` nearest found of ``points``."""
    if factor < 1:
        raise ValueError("factor is at least 1")

    def taking_part(df: DataFrame) -> DataFrame:
        rows = df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return rows.withColumn("dim", F.size("embedding")).distinct()

    held, asked = cut(taking_part(points)), cut(taking_part(queries))
    shards, blocks = -(-held.count() // SHARD_ROWS), -(-asked.count() // BLOCK_QUERIES)
    place = F.xxhash64("vec_id", "embedding")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))

    left = held.withColumn("shard", F.pmod(place, F.lit(max(1, shards))).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(place, F.lit(max(1, blocks))).cast("int")).withColumn("shard", every(shards))

    def best(shard: pa.Table, block: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not shard.num_rows or not block.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        points, asked = matrix(shard["embedding"]), matrix(block["embedding"])
        ids, own = shard["vec_id"].to_numpy().astype(np.int64), block["vec_id"].to_numpy().astype(np.int64)
        _, rows = Tree.build(points).search(asked, k, ids, own, factor)
        q, r = np.nonzero(rows >= 0)
        found = rows[q, r]
        out = [own[q], ids[found], exact_distance(asked[q], points[found])]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    key = ["dim", "shard", "block"]
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(best, "query_id long, vec_id long, score double")
    # an id with several vectors counts with its nearest
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
