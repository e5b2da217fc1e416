"""Exact top-k search for the largest inner product, by one KD-tree per shard.

Components ``x`` become the integers ``floor(scale * x)``. Vectors are dealt to cells by median splits that a bounded sample
fixes (``SAMPLE`` rows), and a cell with many vectors to several shards by hash, so that no shard holds more than about
``SHARD_NUMBERS`` components whatever the data are, copies included. A shard's KD-tree splits its vectors at the median of the
component with the widest range, again and again, down to equal leaves. It is built once and written as a table: one row
per leaf with its ids, its vectors and its tight bounding box; as the splits are even, the boxes of all inner nodes follow
from those of the leaves.

No vector in a box has a larger inner product with ``q`` than the sum of ``max(q * low, q * high)`` over the components. A query
first searches one shard of the cell with the largest such bound. The kth score that it finds goes with the query to the
shards of all cells whose bounds reach it; others are not visited. Inside a shard a query takes the open node with the largest
bound next, and ends when that is below its kth score. Queries go through a shard in blocks, those at the same node together. On
vectors without any structure the boxes overlap, and a query visits most shards; the result is exact in any case.

Scores are exact: where products and sums could pass 2**53 they are made of unbounded integers; a score beyond a long counts as
the largest or smallest long. Only vectors of the same length are compared. Null or empty vectors, such with null components or
components that aren't finite or beyond 1e150, and rows without an id take no part; zero vectors do. An id with several rows
counts once, with its best score. A query doesn't find rows of its own id. Ties go to the smaller id. Fewer candidates
than ``k`` are all returned. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import BATCH_ROWS, cut

#: Rows that fix the cells, and their components together.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 21
#: Components in a shard, about; rows in a shard if there are few vectors; components in a leaf.
SHARD_NUMBERS, SHARD_ROWS, LEAF_NUMBERS = 1 << 21, 1_024, 4_096
#: Components of all cells' boxes together: they are broadcast.
BOX_NUMBERS = 1 << 20
BLOCK_QUERIES = 512
_EXACT = 2.0**53
_LONG = np.iinfo(np.int64)


def finite(embedding: Column) -> Column:
    """Not null, not empty, and every component a finite number whose square is one, too."""
    every = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    return F.coalesce(every & (F.size(embedding) > 0), F.lit(False))


def scaled(rows: pa.Array, scale: float) -> np.ndarray:
    """Rows of equal length as one matrix of whole numbers, held as doubles."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(rows), -1)


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A balanced tree of ``depth`` levels, in level order: ``(component, threshold)``; larger values go to the right."""
    out: list[tuple[int, float]] = []
    level = [sample]
    for _ in range(depth):
        below = []
        for rows in level:
            if not len(rows):
                out.append((0, 0.0))
                below += [rows, rows]
                continue
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            at = float(np.median(rows[:, axis]))
            out.append((axis, at))
            right = rows[:, axis] > at
            below += [rows[~right], rows[right]]
        level = below
    return out


def cells_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if tree:
        axis, threshold = np.array([a for a, _ in tree]), np.array([t for _, t in tree])
        for _ in range(len(tree).bit_length()):
            at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > threshold[at])
    return at - len(tree)


@dataclass
class Shard:
    """A KD-tree: rows in the order of the leaves, and the boxes of all nodes, those of node ``i`` below being ``2i+1`` and ``2i+2``."""

    points: np.ndarray
    ids: np.ndarray
    ends: np.ndarray  # of the leaves
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray) -> Shard:
        order, parts = np.arange(len(points)), [np.arange(len(points))]
        for _ in range(max(0, int(np.ceil(np.log2(max(1, len(points)) / max(4, LEAF_NUMBERS // points.shape[1])))))):
            halves = []
            for rows in parts:
                here = points[rows]
                axis = int(np.argmax(here.max(axis=0) - here.min(axis=0))) if len(rows) else 0
                by = np.argpartition(here[:, axis], len(rows) // 2) if len(rows) else np.arange(0)
                halves += [rows[by[: len(rows) // 2]], rows[by[len(rows) // 2 :]]]
            parts = halves
        order = np.concatenate(parts)
        points, ends = points[order], np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        low = np.array([points[a:b].min(axis=0) for a, b in zip(starts, ends, strict=True)])
        high = np.array([points[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)])
        return cls(points, ids[order], ends, *boxes(low, high))

    def leaf(self, i: int) -> slice:
        return slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, rows)`` of each query's ``k`` best ids, none below its ``least`` score; row -1 where there are fewer."""
        n, leaves = len(queries), len(self.ends)
        unique = len(np.unique(self.ids)) == len(self.ids)
        safe = _safe(queries, self.points)
        best, best_row, floor = np.full((n, k), _LONG.min), np.full((n, k), -1), least.copy()
        open_ = np.full((n, 2 * leaves - 1), -np.inf)  # bounds of the open nodes
        open_[:, 0] = np.inf
        active = np.arange(n)
        while len(active):
            node = open_[active].argmax(axis=1)
            top = open_[active, node]
            going = (top >= floor[active]) & (top > -np.inf)
            active, node = active[going], node[going]
            order = np.argsort(node, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
                who, at = active[group], int(node[group[0]])
                open_[who, at] = -np.inf
                if at < leaves - 1:
                    below = slice(2 * at + 1, 2 * at + 3)
                    open_[who, below] = bounds(queries[who], self.low[below], self.high[below])
                    continue
                rows = np.arange(len(self.ids))[self.leaf(at - leaves + 1)]
                scores, allowed = products(queries[who], self.points[rows], safe), self.ids[rows][None] != own[who][:, None]
                better = (allowed & (scores >= floor[who][:, None])).any(axis=1)
                who, scores, allowed = who[better], scores[better], allowed[better]
                if not len(who):
                    continue
                all_scores = np.concatenate([best[who], scores], axis=1)
                all_rows = np.concatenate([best_row[who], np.where(allowed, rows[None], -1)], axis=1)
                first = self._first(all_scores, all_rows, k, unique)
                best_row[who] = np.where(first < 0, -1, np.take_along_axis(all_rows, first, 1))
                best[who] = np.where(best_row[who] < 0, _LONG.min, np.take_along_axis(all_scores, first, 1))
                floor[who] = np.maximum(floor[who], best[who, -1])
        return best, best_row

    def _first(self, scores: np.ndarray, rows: np.ndarray, k: int, unique: bool) -> np.ndarray:
        """Places of the first ``k`` ids by falling score, then rising id; -1 where there are fewer."""
        ids = self.ids[rows]
        order = np.lexsort((ids, ~scores, rows < 0), axis=1)
        if unique:
            return order[:, :k]
        out = np.full((len(rows), k), -1)
        for i, places in enumerate(order):
            seen: dict[int, int] = {}
            for place in places:
                if rows[i, place] >= 0 and len(seen) < k:
                    seen.setdefault(int(ids[i, place]), int(place))
            out[i, : len(seen)] = list(seen.values())
        return out


def _safe(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all inner products exactly."""
    return not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT


def products(a: np.ndarray, b: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of whole numbers, as longs."""
    if safe:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No inner product of a query with a vector in a box is larger; exact where doubles are."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ high.T + down @ low.T
    if _safe(queries, low) and _safe(queries, high):
        return bound
    return bound + 1e-9 * (up @ np.abs(high).T - down @ np.abs(low).T)


def boxes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of all nodes above the leaves', in level order."""
    levels = [(low, high)]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        levels.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
    return tuple(np.concatenate([x[i] for x in reversed(levels)]) for i in (0, 1))


def _taking_part(rows: DataFrame) -> DataFrame:
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).withColumn("dim", F.size("embedding"))


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(x.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), flat)


_INDEX = "dim int, cell long, part long, leaf int, ids array<long>, points array<double>, low array<double>, high array<double>"


def index(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """The leaves of the KD-trees of all ``vectors(vec_id, embedding)``, each shard's in order."""
    spark = vectors.sparkSession
    held = _taking_part(vectors)
    sizes = {r["dim"]: r["n"] for r in held.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    few = min(SAMPLE, max(256, SAMPLE_NUMBERS // max(sizes, default=1)))
    sample = held.select("dim", "embedding").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(few).toArrow()
    dims = sample["dim"].to_numpy()
    trees: dict[int, list[tuple[int, float]]] = {}
    for dim in np.unique(dims).tolist():
        points = scaled(sample["embedding"].combine_chunks().take(pa.array(np.flatnonzero(dims == dim))), scale)
        wanted = max(sizes[dim] * dim / SHARD_NUMBERS, min(sizes[dim] / SHARD_ROWS, 2 * spark.sparkContext.defaultParallelism))
        wanted = min(wanted, len(points) / 8, BOX_NUMBERS / (2 * dim * len(sizes)))
        trees[dim] = splits(points, max(0, int(np.ceil(np.log2(max(1.0, wanted))))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                cell[of] = cells_of(scaled(batch.column("embedding").take(pa.array(of)), scale), trees.get(int(dim), []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = cut(held.mapInArrow(dealt, "vec_id long, embedding array<double>, dim int, cell long"))
    # by the trees there is a bounded number of cells
    parts = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    parts = parts.withColumn("parts", F.ceil(F.col("n") * F.col("dim") / SHARD_NUMBERS)).drop("n")
    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts"))
    key = ["dim", "cell", "part"]
    dealt_rows = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", place).select(*key, "vec_id", "embedding")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array]] = []
        now: tuple | None = None

        def shard() -> Iterator[pa.RecordBatch]:
            points = np.concatenate([scaled(e, scale) for _, e in held])
            ids = np.concatenate([i.to_numpy() for i, _ in held])
            tree = Shard.build(points, ids)
            leaves = len(tree.ends)
            for i in range(leaves):
                rows = tree.leaf(i)
                boxes = [_lists(x[leaves - 1 + i][None]) for x in (tree.low, tree.high)]
                lists = [_lists(tree.ids[rows][None]), _lists(tree.points[rows].reshape(1, -1)), *boxes]
                where = [pa.array([now[0]], pa.int32()), pa.array([now[1]]), pa.array([now[2]]), pa.array([i], pa.int32())]
                yield pa.RecordBatch.from_arrays([*where, *lists], names=[*key, "leaf", "ids", "points", "low", "high"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            begins = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
            for a, b in zip(begins, begins[1:], strict=False):
                if a == b:
                    continue
                if now != (here := tuple(keys[a].tolist())):
                    if held:
                        yield from shard()
                    now, held = here, []
                held.append((batch.column("vec_id").slice(a, b - a), batch.column("embedding").slice(a, b - a)))
        if held:
            yield from shard()

    return cut(dealt_rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(built, _INDEX))


def _cell_boxes(leaves: DataFrame) -> list:
    """``(dim, cell, parts, low, high)`` of each cell: their number is bounded by the trees."""
    schema = "dim int, cell long, parts long, low array<double>, high array<double>"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("dim", "cell", "parts")), strict=True)
            for i, (dim, cell, parts) in enumerate(keys):
                low, high = (batch.column(c)[i].values.to_numpy() for c in ("low", "high"))
                if old := seen.get((dim, cell)):
                    parts, low, high = max(parts, old[0]), np.minimum(low, old[1]), np.maximum(high, old[2])
                seen[dim, cell] = parts, low, high
        if seen:
            rows = [(*k, v[0], v[1].tolist(), v[2].tolist()) for k, v in seen.items()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "parts", "low", "high"])

    some = leaves.select("dim", "cell", (F.col("part") + 1).alias("parts"), "low", "high")
    return some.mapInArrow(merged, schema).repartition("dim", "cell").mapInArrow(merged, schema).collect()


_ROWS = "dim int, cell long, part long, side int, leaf int, ids array<long>, points array<double>, low array<double>, high array<double>, least long"


def _searched(leaves: DataFrame, asked: DataFrame, k: int, scale: float) -> DataFrame:
    """``(query_id, vec_id, score)``: the best of each shard for the queries ``asked`` of it, in the same columns as leaves."""
    key = ["dim", "cell", "part"]
    held = leaves.withColumn("side", F.lit(0)).withColumn("least", F.lit(None).cast("long"))
    both = held.unionByName(asked).select([f.split()[0] for f in _ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        tree: Shard | None = None
        now: tuple | None = None

        def read() -> Shard:
            """The tree of the leaves that have been read."""
            dim = now[0]
            low, high, points = (np.concatenate([b.column(c).flatten().to_numpy() for b in parts]).reshape(-1, dim) for c in ("low", "high", "points"))
            ids = np.concatenate([b.column("ids").flatten().to_numpy() for b in parts])
            ends = np.cumsum(np.concatenate([b.column("ids").value_lengths().to_numpy() for b in parts]))
            return Shard(points, ids, ends, *boxes(low, high))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*key, "side")], axis=1)
            begins = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(begins, begins[1:], strict=False):
                if a == b:
                    continue
                here, some = tuple(keys[a, :3].tolist()), batch.slice(a, b - a)
                if here != now:
                    now, parts, tree = here, [], None
                if keys[a, 3] == 0:
                    parts.append(some)
                    continue
                if tree is None:
                    tree, parts = read(), []
                for i in range(0, some.num_rows, BLOCK_QUERIES):
                    block = some.slice(i, BLOCK_QUERIES)
                    own = block.column("ids").flatten().to_numpy()
                    least = block.column("least").fill_null(int(_LONG.min)).to_numpy()
                    scores, rows = tree.search(scaled(block.column("points"), scale), own, k, least)
                    q, r = np.nonzero(rows >= 0)
                    columns = [own[q], tree.ids[rows[q, r]], scores[q, r]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    ordered = both.repartition(*key).sortWithinPartitions(*key, "side", "leaf")
    return ordered.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, leaves: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries(vec_id, embedding)`` the ``k`` largest inner products.

    ``leaves`` is the index of ``vectors``, if there is one already.
    """
    leaves = index(vectors, scale) if leaves is None else leaves
    boxes_of = _cell_boxes(leaves)
    cells: dict[int, tuple] = {}
    for dim in {r["dim"] for r in boxes_of}:
        of = sorted((r for r in boxes_of if r["dim"] == dim), key=lambda r: r["cell"])
        cells[dim] = tuple(np.array([r[c] for r in of]) for c in ("cell", "parts", "low", "high"))
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def sent(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """Each query with one shard of its best cell, or with all others that its bound reaches."""
        for batch in batches:
            dims, vectors = batch.column("dim").to_numpy(), batch.column("embedding")
            for dim in np.unique(dims).tolist():
                if dim not in cells:
                    continue
                cell, parts, low, high = cells[dim]
                of = np.flatnonzero(dims == dim)
                ids = batch.column("vec_id").to_numpy()[of]
                bound = bounds(scaled(vectors.take(pa.array(of)), scale), low, high)
                home = bound.argmax(axis=1)
                home_part = ids % parts[home]
                least = batch.column("least").fill_null(int(_LONG.min)).to_numpy()[of]
                if first:
                    who, at, part = np.arange(len(of)), home, home_part
                else:
                    who, at = np.nonzero(bound >= least[:, None])
                    n = parts[at]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    who, at = np.repeat(who, n), np.repeat(at, n)
                    new = (at != home[who]) | (part != home_part[who])
                    who, at, part = who[new], at[new], part[new]
                for a in range(0, len(who), BATCH_ROWS):
                    w, c, p = (x[a : a + BATCH_ROWS] for x in (who, at, part))
                    rows, none = vectors.take(pa.array(of[w])), pa.nulls(len(w), pa.list_(pa.float64()))
                    numbers = [np.full(len(w), dim, np.int32), cell[c], p, np.ones(len(w), np.int32), np.zeros(len(w), np.int32)]
                    columns = [*map(pa.array, numbers), _lists(ids[w][:, None]), rows, none, none, pa.array(least[w])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    asked = cut(_taking_part(queries).distinct().withColumn("least", F.lit(None).cast("long")))
    begun = cut(_searched(leaves, asked.mapInArrow(lambda b: sent(b, True), _ROWS), k, scale))
    # the kth score of a query is a lower bound of the one it looks for
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = begun.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = best.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = _searched(leaves, asked.drop("least").join(kth, "vec_id", "left").select(asked.columns).mapInArrow(lambda b: sent(b, False), _ROWS), k, scale)
    found = begun.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v)::BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
