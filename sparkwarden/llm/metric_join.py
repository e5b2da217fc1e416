"""Embedding near-duplicates by an exact metric range join.

On unit vectors ``cosine >= c`` is a Euclidean distance of at most ``r = sqrt(2 - 2c)``. Each vector belongs to the cell of
its nearest pivot and is a boundary copy of another cell only if a vector of that cell can lie within ``r``: by the triangle
inequality its distance to that cell's pivot then lies within ``r`` of the cell's nearest to farthest member, and its
distance to the plane between the two pivots is at most ``r``. Of two cells the later one sends copies to the earlier.

Vectors are stored once, in blocks of one cell. In many dimensions most vectors are copies of most cells, so copies are
never written or shuffled: the blocks are broadcast slab by slab (``SLAB_BYTES``, a dense cell in several slabs), and each
task joins its stored blocks with the members of their cell and the boundary copies that it finds in the slab. The disk
thus holds the vectors once in an exchange and once in blocks, whatever the number of cells. The work still grows with the
square of the vectors where cells do not part them.

A task compares a block with columns of the slab by matrix products. First come products of a few leading coordinates
after a rotation and the length of the rest, which bound the cosine from above; only pairs above the threshold are
compared in full, and values near the threshold are decided in double precision. A task returns each vector's number of
links and a spanning forest of them, never all pairs. Equal vectors are joined once, with their number. Pivots are at most
``MOST_PIVOTS`` vectors, taken by hash; they are broadcast.

Null, empty or zero vectors, such with null or non-finite components, and rows without an id link with nothing: they have
no links and are kept. Only vectors of equal length link. Rows that agree in id and vector are one vector. Every input row
gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut
from sparkwarden.llm.components import components
from sparkwarden.llm.vectors import matrix, usable

MOST_PIVOTS = 1_024
CELL_ROWS = 4_096
#: Vectors of a stored block, and bytes of their values.
BLOCK_ROWS, BLOCK_BYTES = 1_024, 1 << 18
#: Bytes of vectors that are broadcast at once, and that a task sorts by cell at once.
SLAB_BYTES = HELD_BYTES = 1 << 25
#: Pairs compared by one matrix product.
TILE_PAIRS = 1 << 19
#: Single precision products are trusted outside this distance from the threshold.
DOUBT = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def leading(sample: np.ndarray, cosine: float) -> np.ndarray:
    """Orthonormal directions whose coordinates tell most pairs apart, by the cost of products and of full comparisons."""
    dim = sample.shape[1]
    basis = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    best, least = basis, 0.5 + 0.05 * dim  # nanoseconds a pair; a full comparison takes about 150
    for k in (k for k in (8, 16, 24, 32, 48, 64, 96, 128, 192, 256) if k < dim):
        short = shortened(sample, basis[:, :k])
        passed = np.count_nonzero(np.triu(short @ short.T >= cosine - DOUBT, 1)) / max(1, len(sample) * (len(sample) - 1) / 2)
        if (cost := 0.5 + 0.05 * k + 150 * passed) < least:
            best, least = basis[:, :k], cost
    return np.ascontiguousarray(best)


def shortened(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors in the basis and the length of the rest: their products are no less than the cosines."""
    z = x @ basis
    return np.concatenate([z, np.sqrt(np.maximum(0, 1 - (z * z).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)


def true_cells(hit: np.ndarray, hits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, quick if few cells are true; ``hits`` is their number, if known."""
    if (np.count_nonzero(hit) if hits is None else hits) > hit.size >> 10:
        return np.divmod(np.flatnonzero(hit), hit.shape[1])
    data, at, k = hit.tobytes(), [], -1
    while (k := data.find(1, k + 1)) >= 0:
        at.append(k)
    return np.divmod(np.array(at, np.int64), hit.shape[1])


class Side(NamedTuple):
    """Vectors of equal length: values as given, unit vectors in single precision."""

    raw: np.ndarray
    x: np.ndarray

    def exact(self, other: Side, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
        """Whether pairs have at least this cosine, in double precision."""
        out, step = np.empty(len(i), bool), max(1, (1 << 20) // self.x.shape[1])
        for k in range(0, len(i), step):
            out[k : k + step] = (unit(self.raw[i[k : k + step]]) * unit(other.raw[j[k : k + step]])).sum(axis=1) >= cosine
        return out

    def linked(self, other: Side, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
        """Whether pairs have at least this cosine."""
        near, step = np.empty(len(i), np.float32), max(1, (1 << 20) // self.x.shape[1])
        for k in range(0, len(i), step):
            near[k : k + step] = np.einsum("ij,ij->i", self.x[i[k : k + step]], other.x[j[k : k + step]])
        out = near >= cosine
        doubt = np.flatnonzero(np.abs(near - np.float32(cosine)) < DOUBT)
        out[doubt] = self.exact(other, i[doubt], j[doubt], cosine)
        return out

    def all_linked(self, other: Side, columns: np.ndarray, cosine: float) -> np.ndarray:
        """Boolean matrix of all vectors with these of the other side."""
        near = self.x @ other.x[columns].T
        out = near >= cosine
        i, j = true_cells(np.abs(near - np.float32(cosine)) < DOUBT)
        out[i, j] = self.exact(other, i, columns[j], cosine)
        return out


class Labels:
    """Union-find of a slab's columns over all blocks of a task, so that links within what is connected are left out."""

    def __init__(self, n: int):
        self.up, self.known, self.vain = np.arange(n), np.arange(n), 0

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def some(self, linked: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, place in columns)`` of links that connect, with what is connected, the same as all links of the matrix."""
        hit = np.flatnonzero(linked.any(axis=0))
        labels, which = np.unique(self.known[columns[hit]], return_inverse=True)
        if len(labels) > 16:
            return forest(linked)
        rows, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(len(labels)):
            part = linked[:, hit[which == k]]
            rows.append(np.flatnonzero(part.any(axis=1)))
            at.append(hit[which == k][part[rows[-1]].argmax(axis=1)])
        return np.concatenate(rows), np.concatenate(at)

    def join(self, row_label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
        """Connect rows of a block with columns; those of the links that were needed for it. ``row_label`` is -1 for a row without any."""
        new = np.flatnonzero(row_label[i] != self.known[j])
        if not len(new):
            return [], []
        _, first = np.unique(i[new] * len(self.up) + self.known[j[new]], return_index=True)
        rows, columns = [], []
        for row, column in zip(i[new[first]].tolist(), j[new[first]].tolist(), strict=True):
            root = self.find(column)
            if row_label[row] >= 0:
                own = self.find(row_label[row])
                if own == root:
                    row_label[row], self.vain = root, self.vain + 1
                    continue
                self.up[max(own, root)] = root = min(own, root)
            row_label[row] = root
            rows.append(row)
            columns.append(column)
        if self.vain >= 512:  # links that the labels known would have left out
            self.vain = 0
            while ((up := self.up[self.up]) != self.up).any():
                self.up = up
            self.known = self.up.copy()
        return rows, columns


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of fewer links that connect the same rows and columns."""
    if linked.sum() <= 4 * sum(linked.shape):
        return np.nonzero(linked)
    rows, cols = [], []
    open_rows, open_cols = linked.any(axis=1), np.ones(linked.shape[1], bool)
    while open_rows.any():
        front = np.flatnonzero(open_rows)[:1]
        open_rows[front] = False
        while len(front):
            for r in front:  # each row takes the columns nobody has reached
                new = np.flatnonzero(linked[r] & open_cols)
                open_cols[new] = False
                rows.append(np.full(len(new), r))
                cols.append(new)
            reached = np.concatenate(cols[-len(front) :])
            nxt = []
            for c in reached:
                new = np.flatnonzero(linked[:, c] & open_rows)
                open_rows[new] = False
                rows.append(new)
                cols.append(np.full(len(new), c))
                nxt.append(new)
            front = np.concatenate(nxt) if nxt else np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def copied(x: np.ndarray, own: np.ndarray, pivots: np.ndarray, apart: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float) -> np.ndarray:
    """Boolean matrix: which unit vectors of cells ``own`` can lie within the radius of a member of each cell."""
    products = x @ pivots.T
    far = np.sqrt(np.maximum(0, 2 - 2 * products))
    plane = products[np.arange(len(x)), own][:, None] - products <= radius * apart[own] + 1e-9
    return plane & (far <= high + radius) & (far >= low - radius)


def range_join(values: DataFrame, tally: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``(counts(key, n), links(a, b))`` of ``values(key, embedding)``; by ``tally(key, many)``, ``many`` rows have that vector.

    Rows of ``values`` with one key are one vector; each key is once in ``tally``, a written table. ``n`` counts the rows of
    other vectors that are linked; the links connect what all links connect.
    """
    if not -1 < cosine <= 1:
        raise ValueError("cosine must be above -1 and at most 1")
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    spark = values.sparkSession
    sc = spark.sparkContext
    kind = np.float32 if dict(values.dtypes)["embedding"] == "array<float>" else np.float64
    most_rows, most_bytes, held_bytes, tile_pairs = BLOCK_ROWS, BLOCK_BYTES, HELD_BYTES, TILE_PAIRS

    first = tally.orderBy("key").limit(MOST_PIVOTS).select("key")
    sample: dict[int, list] = {}
    pivots: dict[int, np.ndarray] = {}
    many_pivots = min(MOST_PIVOTS, max(1, -(-tally.count() // CELL_ROWS)))
    taken = values.join(F.broadcast(first), "key").groupBy("key").agg(F.first("embedding").alias("embedding")).collect()
    for place, row in enumerate(sorted(taken)):
        sample.setdefault(len(row[1]), []).append(row[1])
        if place < many_pivots:
            pivots[len(row[1])] = unit(np.array(sample[len(row[1])], np.float64))
    # vectors of a length without pivot share one cell
    plan = sc.broadcast({d: (pivots.get(d, np.eye(1, d)), leading(unit(np.array(s, np.float64)), cosine)) for d, s in sample.items()})

    def plan_of(dim: int) -> tuple[np.ndarray, np.ndarray]:
        return plan.value[dim] if dim in plan.value else (np.eye(1, dim), np.eye(dim, min(dim, 16)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim))
                raw = matrix(part["embedding"]).astype(kind)
                key, many = part["key"].to_numpy(), part["many"].to_numpy()
                cell, far = np.empty(len(raw), np.int64), np.empty(len(raw))
                for k in range(0, len(raw), 4096):
                    products = unit(raw[k : k + 4096]) @ plan_of(dim)[0].T
                    cell[k : k + 4096] = products.argmax(axis=1)
                    far[k : k + 4096] = np.sqrt(np.maximum(0, 2 - 2 * products.max(axis=1)))
                order = np.argsort(cell, kind="stable")
                ends = np.flatnonzero(np.diff(cell[order], append=-1)) + 1
                step = max(1, min(most_rows, most_bytes // (dim * raw.itemsize)))
                out = []
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    for k in range(a, b, step):
                        at = order[k : min(k + step, b)]
                        number += 1
                        out.append((number, dim, int(cell[at[0]]), len(at), float(far[at].min()), float(far[at].max()), key[at].tobytes(), many[at].tobytes(), raw[at].tobytes()))
                names = ["block", "dim", "cell", "n", "low", "high", "keys", "many", "x"]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= held_bytes:
                yield from flush()
        if held:
            yield from flush()

    # one row of each key by the exchange that also meets the tally
    distinct = values.groupBy("key").agg(F.first("embedding").alias("embedding")).join(tally.hint("merge"), "key")
    distinct = distinct.select("key", F.col("many").cast("long"), F.size("embedding").alias("dim"), "embedding")
    stored = cut(distinct.mapInArrow(blocks, "block long, dim int, cell int, n int, low double, high double, keys binary, many binary, x binary"))
    found = stored.groupBy("dim", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim", "cell").collect()
    rings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in found:
        low, high = rings.setdefault(r["dim"], tuple(np.full((2, len(plan_of(r["dim"])[0])), np.nan)))
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]

    def slab(rows: DataFrame) -> dict[int, dict[str, np.ndarray]]:
        """The blocks of some rows as arrays by length, in the order of cells and blocks."""
        table, out = rows.select("block", "dim", "cell", "n", "keys", "many", "x").toArrow(), {}
        dims, cells, numbers = (table[c].to_numpy() for c in ("dim", "cell", "block"))
        for dim in np.unique(dims).tolist():
            order = np.lexsort([numbers, cells])
            part = table.take(pa.array(order[dims[order] == dim]))
            n = part["n"].to_numpy()
            of = lambda c, t: np.frombuffer(b"".join(part[c].to_pylist()), t)  # noqa: B023, E731
            out[dim] = {c: np.repeat(part[c].to_numpy().astype(np.int64), n) for c in ("cell", "block")}
            out[dim] |= {"key": of("keys", np.int64), "many": of("many", np.int64).astype(np.float64), "raw": of("x", kind).reshape(n.sum(), dim)}
            out[dim] |= {"low": rings[dim][0], "high": rings[dim][1]}
        return out

    def prepared(part: dict[str, np.ndarray], dim: int) -> dict[str, np.ndarray]:
        """With unit vectors, shortened ones, and for each cell the bits of its members and boundary copies; once in a worker."""
        if "x" not in part:
            p, basis = plan_of(dim)
            raw, n = part["raw"], len(part["raw"])
            apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) + 1e-7
            x, z, bits = np.empty((n, dim), np.float32), np.empty((n, basis.shape[1] + 1), np.float32), np.empty((len(p), -(-n // 8)), np.uint8)
            for k in range(0, n, 4096):
                u = unit(raw[k : k + 4096])
                x[k : k + 4096], z[k : k + 4096] = u, shortened(u, basis)
                bits[:, k // 8 : k // 8 + 512] = np.packbits(copied(u, part["cell"][k : k + 4096], p, apart, part["low"], part["high"], radius).T, axis=1)
            part |= {"x": x, "z": z, "bits": bits}
        return part

    def joined(slab_of: dict[int, dict[str, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {dim: np.zeros(len(part["key"])) for dim, part in slab_of.items()}
        labels = {dim: Labels(len(part["key"])) for dim, part in slab_of.items()}

        def batch_of(key: list[np.ndarray], n: list[np.ndarray], left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
            key, n, left, right = (np.concatenate([np.empty(0, np.int64), *v]) for v in (key, n, left, right))
            some = np.flatnonzero(n)
            a = pa.array(np.concatenate([key[some], left]))
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(right)])
            return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([np.rint(n[some]).astype(np.int64), np.zeros(len(left), np.int64)]))], names=["a", "b", "n"])

        for batch in batches:
            out: tuple[list, list, list, list] = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("dim", "cell", "block", "keys", "many", "x")]
            for dim, cell, block, keys, manys, values_of in zip(*columns, strict=True):
                if dim not in slab_of:
                    continue
                part = prepared(slab_of[dim], dim)
                key, many = np.frombuffer(keys, np.int64), np.frombuffer(manys, np.int64).astype(np.float64)
                # a block meets the later columns: of its cell, and boundary copies from later cells
                begin, end = np.searchsorted(part["cell"], [cell, cell + 1])
                start, own = begin + np.searchsorted(part["block"][begin:end], [block, block + 1])
                close = np.unpackbits(part["bits"][cell], count=len(part["key"]))[start:].view(bool)
                close[: end - start] = True
                dense = np.count_nonzero(close) > 0.6 * len(close)  # then the rest costs less than it takes to leave it out
                chosen = start + (np.arange(len(close)) if dense else np.flatnonzero(close))
                raw = np.frombuffer(values_of, kind).reshape(len(key), dim)
                u = unit(raw)
                one, other, z = Side(raw, u.astype(np.float32)), Side(part["raw"], part["x"]), shortened(u, plan_of(dim)[1])
                n, row_label = np.zeros(len(key)), np.full(len(key), -1)
                step = max(1024, tile_pairs // len(key))
                for k in range(0, len(chosen), step):
                    at = chosen[k : k + step]
                    hit = z @ (part["z"][at[0] : at[-1] + 1] if dense else part["z"][at]).T >= cosine - DOUBT
                    if at[0] < own:  # of the block itself, each pair once
                        hit[:, at < own] &= (at[at < own] - start)[None] > np.arange(len(key))[:, None]
                    if (hits := np.count_nonzero(hit)) > hit.size >> 5:
                        linked = one.all_linked(other, at, cosine) & hit
                        n += linked.astype(np.float32) @ part["many"][at]
                        counts[dim][at] += many @ linked.astype(np.float32)
                        i, j = labels[dim].some(linked, at)
                        j = at[j]
                    elif hits:
                        i, j = true_cells(hit, hits)
                        j = at[j]
                        linked = one.linked(other, i, j, cosine)
                        i, j = i[linked], j[linked]
                        n += np.bincount(i, part["many"][j], len(key))
                        np.add.at(counts[dim], j, many[i])
                    else:
                        continue
                    if len(i):
                        rows, cols = labels[dim].join(row_label, i, j)
                        out[2].append(key[rows])
                        out[3].append(part["key"][cols])
                out[0].append(key)
                out[1].append(n)
            yield batch_of(*out)
        yield batch_of([part["key"] for part in slab_of.values()], [*counts.values()], [], [])

    def turn(where: Column, least_dim: int, last: tuple[int, int]) -> DataFrame:
        """The join of these blocks with all that come before them or are theirs, written."""
        here = sc.broadcast(slab(stored.where(where)))
        rows = stored.where(between((least_dim, 0), last)).select("dim", "cell", "block", "keys", "many", "x")
        done = cut(rows.mapInArrow(lambda batches: joined(here.value, batches), "a long, b long, n long"))
        here.destroy()
        return done

    turns: list[DataFrame] = []
    open_cells: list[tuple[int, int]] = []
    size = 0
    for r in [*found, None]:
        bytes_of = r["n"] * r["dim"] * np.dtype(kind).itemsize if r else 0
        if open_cells and (r is None or size + bytes_of > SLAB_BYTES):
            turns.append(turn(between(open_cells[0], open_cells[-1]), open_cells[0][0], open_cells[-1]))
            open_cells, size = [], 0
        if r and bytes_of > SLAB_BYTES:
            at, pieces = (r["dim"], r["cell"]), -(-bytes_of // SLAB_BYTES)
            for piece in range(pieces):
                turns.append(turn(between(at, at) & (F.pmod(F.xxhash64("block"), F.lit(pieces)) == piece), r["dim"], at))
        elif r:
            open_cells.append((r["dim"], r["cell"]))
            size += bytes_of
    done = turns[0] if turns else spark.createDataFrame([], "a long, b long, n long")
    for more in turns[1:]:
        done = done.unionByName(more)
    counts = done.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    return counts, done.where("b IS NOT NULL").select("a", "b")


def between(lo: tuple[int, int], hi: tuple[int, int]) -> Column:
    """Rows from one ``(dim, cell)`` to another."""
    dim, cell = F.col("dim"), F.col("cell")
    return ((dim > lo[0]) | (dim == lo[0]) & (cell >= lo[1])) & ((dim < hi[0]) | (dim == hi[0]) & (cell <= hi[1]))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    ``vectors`` is read three times and not stored again, so it is to be a written table.
    """
    rows = vectors.select("vec_id", "embedding")
    part = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumn("key", F.when(part, F.xxhash64("embedding")))
    keyed = cut(rows.select("vec_id", "key"))
    used = keyed.where("key IS NOT NULL").distinct()
    distinct = cut(used.groupBy("key").agg(F.count("*").alias("many"), F.min("vec_id").alias("least")))
    counts, links = range_join(rows.where("key IS NOT NULL").select("key", "embedding"), distinct.select("key", "many"), cosine)
    group = components(links).select(F.col("node").alias("key"), "component")
    known = distinct.select("key", "many", "least").join(counts, "key", "left").join(group, "key", "left")
    known = cut(known.withColumn("component", F.coalesce("component", "key")))
    named = cut(known.groupBy("component").agg(F.min("least").alias("component_id")))
    known = cut(known.join(named, "component").selectExpr("key", "coalesce(n, 0) + many - 1 AS n_links", "component_id"))
    out = keyed.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
