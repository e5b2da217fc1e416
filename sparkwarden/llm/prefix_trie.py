"""The trie of conversations' common beginnings, by hashes of blocks of turns.

A conversation is cut into blocks of ``BLOCK`` turns; a block's digest is that of the one before it and its turns, so that equal
digests mean equal beginnings. Conversations are grouped by their successive block digests first: a group holds all members
of a beginning, in one row, whatever their number. Only where one beginning goes on in several different blocks are the turn
boundaries inside these blocks refined: the groups (not the conversations) are spread over their turns and gathered by the
digest of each turn's beginning. A block without siblings is a chain of nodes with the same members and needs no gathering.

Sums over subtrees don't walk the tree. Every node is named by its smallest member, which names a stretch of nodes along its
own path. A conversation carries the weight of all nodes it names; a node's subtree weighs what its members carry, less what
its own name carries above it. Members are summed by block groups and refined like the counts. Childless nodes, of which
a conversation names one at most, are counted the same way.

The lists of members that end at a node are hashed in sorted stretches: a stretch that holds a whole list digests it, and the
parts of a list that goes on in the next stretch are joined in order, a part of bounded length at a time.

Turns are ordered by turn (nulls first), role, the text's first 64 characters and digest; equal rows are repeated rows. Null
roles and texts are empty. Rows without ``conv_id`` take no part. No conversation gives no node. Other columns are dropped. One
conversation is read in order by one task, as digests and lengths only. A parent with very many children doesn't gather them
in one task: such parents, of which there are few by count, are looked up in a broadcast table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, lookup

BLOCK = 4
#: Bytes of a digest, and the key of the textless root.
WIDTH = 16
ROOT = b"\0" * WIDTH
HEAD = 64
#: Characters of a part of a list.
PART_CHARS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

_TURNS = "conv_id long, digest binary, size long"
_BLOCKS = "conv_id long, block long, at binary, `to` binary, digests binary, sizes array<long>, last boolean"


def _digest(x: Column) -> Column:
    return F.substring(F.unhex(F.sha2(x, 256)), 1, WIDTH)


def turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, head, digest, size)`` of each row: what is needed of the texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, HEAD).alias("head"),
        _digest(whole).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """``(conv_id, digest, size)``: conversations one after the other in each partition, their turns in order."""
    order = ["conv_id", "turn", "role", "head", "digest"]
    return turns(rows).repartition("conv_id").sortWithinPartitions(order).select("conv_id", "digest", "size")


def spliced(rows: DataFrame) -> DataFrame:
    """As ``in_order``, but conversation ``c`` begins with the first ``h`` turns of ``c - c % 5`` in place of its own.

    ``h`` is crc32 of ``c`` as decimal text, modulo 9. A conversation that has no turn then is one row without digest.
    """
    family = F.col("conv_id") - F.col("conv_id") % 5
    order = ["family", "conv_id <> family", "conv_id", "turn", "role", "head", "digest"]
    near = turns(rows).withColumn("family", family).repartition("family").sortWithinPartitions(*map(F.expr, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        of: int | None = None
        shared: list[tuple[bytes, int]] = []  # first turns of the family's own conversation
        out: list[tuple] = []
        h = place = written = 0
        for batch in batches:
            for f, conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("family", "conv_id", "digest", "size")), strict=True):
                if f != of:
                    of, shared = f, []
                if conv != now:
                    if now is not None and not written:
                        out.append((now, None, 0))
                    now, h, place = conv, zlib.crc32(str(conv).encode()) % 9, 0
                    first = [] if conv == f else shared[:h]
                    out += [(conv, *turn) for turn in first]
                    written = len(first)
                place += 1
                if conv == f and place <= 8:
                    shared.append((digest, size))
                if conv == f or place > h:
                    out.append((conv, digest, size))
                    written += 1
            if out:
                yield _batch(out, ("conv_id", "digest", "size"))
                out = []
        if now is not None and not written:
            yield _batch([(now, None, 0)], ("conv_id", "digest", "size"))

    return near.select("family", "conv_id", "digest", "size").mapInArrow(run, _TURNS)


_KINDS = {"digest": pa.binary(), "at": pa.binary(), "to": pa.binary(), "digests": pa.binary(), "sizes": pa.list_(pa.int64())}
_KINDS |= {"key": pa.binary(), "last": pa.bool_(), "whole": pa.bool_(), "part": pa.string()}


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = [pa.array(c, _KINDS.get(n, pa.int64())) for c, n in zip(zip(*rows, strict=True), names, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def blocks(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of conversations that lie in order: digest before and behind, the turns' digests and sizes.

    Each conversation has a block 0 without turns, which leads to the root; ``last`` marks where it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "block", "at", "to", "digests", "sizes", "last")
        now: int | None = None
        out: list[tuple] = []
        number, at, held, sizes = 0, b"", [], []

        def close(last: bool) -> None:
            nonlocal number, at, held, sizes
            digests = b"".join(held)
            to = hashlib.sha256(at + digests).digest()[:WIDTH] if number else ROOT
            out.append((now, number, at or None, to, digests, sizes, last))
            number, at, held, sizes = number + 1, to, [], []

        for batch in batches:
            for conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "size")), strict=True):
                if conv != now:
                    if now is not None:
                        close(True)
                    now, number, at = conv, 0, b""
                if digest is None:
                    continue
                if not number or len(held) == block:  # there is one more turn: this block isn't the last
                    close(False)
                held.append(digest)
                sizes.append(size)
            if out:
                yield _batch(out, names)
                out.clear()
        if now is not None:
            close(True)
            yield _batch(out, names)

    return ordered.mapInArrow(run, _BLOCKS)


def groups(blocks: DataFrame) -> DataFrame:
    """One row per different block of a beginning: its members, those that end in it, and whether it has siblings."""
    # all other keys follow from ``to``; as keys they need no buffer
    found = cut(
        blocks.groupBy("to", "at", "block", "digests", "sizes").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.col("last").cast("long")).alias("n_ends")
        )
    )
    siblings = found.groupBy("at").agg((F.count("*") > 1).alias("diverges"))
    return cut(lookup(found, siblings.where("at IS NOT NULL"), "at").withColumn("diverges", F.coalesce("diverges", F.lit(False))))


def spread(groups: DataFrame, sums: dict[str, Column], keep: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes inside the groups' blocks: ``sums`` added up (``conv_id`` is the least), ``keep`` follows from the node.

    In both, ``is_end`` says that the node is the last one of its group's block.
    """
    sums, keep = sums or {}, keep or {}
    part = groups.where("block > 0").select("*", F.posexplode("sizes").alias("i", "size"))
    upto = lambda i: F.when(i == 0, F.col("at")).otherwise(
        _digest(F.concat("at", F.substring("digests", F.lit(1), i * WIDTH)))
    )
    is_end = F.col("i") == F.size("sizes") - 1
    part = part.select(
        upto(F.col("i") + 1).alias("key"),
        upto(F.col("i")).alias("parent"),
        ((F.col("block") - 1) * block + F.col("i") + 1).alias("depth"),
        "size",
        "diverges",
        (~F.col("diverges") & ~is_end).alias("one_child"),
        (~F.col("diverges") & (F.col("i") > 0)).alias("in_chain"),
        is_end.alias("is_end"),
        "conv_id",
        *[c for c in groups.columns if c not in ("block", "at", "to", "digests", "sizes", "diverges", "conv_id")],
    )
    names = ["key", "parent", "depth", "size", "one_child", "in_chain"]
    values = part.select(*names, "diverges", "conv_id", *[c.alias(n) for n, c in sums.items()])
    added = values.where("diverges").groupBy(names).agg(F.min("conv_id").alias("conv_id"), *[F.sum(n).alias(n) for n in sums])
    chain = values.where("NOT diverges").drop("diverges")
    top = groups.where("block = 0").withColumn("is_end", F.lit(True)).select(
        F.col("to").alias("key"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("size"),
        F.lit(False).alias("one_child"),
        F.lit(False).alias("in_chain"),
        "conv_id",
        *[c.alias(n) for n, c in sums.items()],
    )
    return added.unionByName(chain).unionByName(top)


def list_digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the ids of ``ends(key, conv_id)`` in ascending order, joined by commas."""
    names = ("key", "first", "whole", "part")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A list that lies inside the partition, first and last key left out, is digested; others are cut into parts."""
        out: list[tuple] = []
        key: bytes | None = None
        first, held, chars, begun, cut_before = 0, [], 0, False, False

        def close(inside: bool) -> None:
            text = ",".join(held)
            out.append((key, first, inside, hashlib.sha256(text.encode()).hexdigest() if inside else text))

        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        close(begun and not cut_before)
                        begun = True
                    key, first, held, chars, cut_before = k, conv, [], 0, False
                elif chars > PART_CHARS:
                    close(False)
                    first, held, chars, cut_before = conv, [], 0, True
                held.append(str(conv))
                chars += len(held[-1]) + 1
            if out:
                yield _batch(out, names)
                out.clear()
        if key is not None:
            close(False)
            yield _batch(out, names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: bytes | None = None
        now = hashlib.sha256()
        for batch in batches:
            out = []
            for k, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if k == key:
                    now.update(b",")
                else:
                    if key is not None:
                        out.append((key, now.hexdigest()))
                    key, now = k, hashlib.sha256()
                now.update(part.encode())
            if out:
                yield _batch(out, ("key", "part"))
        if key is not None:
            yield _batch([(key, now.hexdigest())], ("key", "part"))

    stretches = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    cutup = cut(stretches.mapInArrow(parts, "key binary, first long, whole boolean, part string"))
    open_ = cutup.where("NOT whole").repartition("key").sortWithinPartitions("key", "first").select("key", "part")
    done = cutup.where("whole").select("key", F.col("part").alias("ends_sha256"))
    return done.unionByName(open_.mapInArrow(joined, "key binary, ends_sha256 string"))


def trie(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of conversations that lie in order, as ``in_order`` and ``spliced`` give them.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the smallest member names the
    node; ``saved_tokens`` adds up, over the subtree, the bytes of a node's last text for each member beyond the first.
    """
    held = cut(blocks(ordered, block))
    grouped = groups(held)
    counts = {"n": F.col("n"), "ends": F.when(F.col("is_end"), F.col("n_ends")).otherwise(0)}
    nodes = cut(spread(grouped, counts, block=block))

    # a node all of whose members end there has no child
    weight, leaf = (F.col("n") - 1) * F.col("size"), F.col("ends") == F.col("n")
    named = nodes.where(leaf | (F.col("n") > 1)).groupBy("conv_id")
    carried = named.agg(F.sum(weight).alias("weight"), F.max(leaf.cast("long")).alias("leaves"))
    of_groups = (
        held.select("conv_id", "to").join(carried, "conv_id").groupBy("to").agg(F.sum("weight").alias("weight"), F.sum("leaves").alias("leaves"))
    )
    weighed = grouped.join(of_groups, "to", "left").fillna(0, ["weight", "leaves"])
    below = spread(weighed, {"weight": F.col("weight"), "leaves": F.col("leaves"), "n": F.col("n")}, block=block)
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    shared = nodes.where("n > 1").withColumn("above", F.coalesce(F.sum(weight).over(above), F.lit(0))).select("key", "above")
    sums = shared.join(below.where("n > 1").select("key", "weight", "leaves"), "key")
    sums = sums.select("key", (F.col("weight") - F.col("above")).alias("saved_tokens"), F.col("leaves").alias("n_leaves"))

    children = nodes.where("NOT in_chain AND parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    digests = list_digests(held.where("last").select(F.col("to").alias("key"), "conv_id"))
    told = nodes.join(sums, "key", "left").join(children, "key", "left").join(digests, "key", "left")
    told = cut(
        told.select(
            "parent",
            "in_chain",
            "conv_id",
            "depth",
            F.col("n").alias("n_convs"),
            F.when(F.col("one_child"), 1).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )
    # inside a chain the parent has the same members
    names = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    outer = cut(told.where("NOT in_chain"))
    found = lookup(outer, names, "parent").unionByName(told.where("in_chain").withColumn("parent_conv_id", F.col("conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.select(columns)


def sql(crc_table: str, crc: str) -> str:
    """The trie of spliced conversations: every beginning as one digest, every subtree as a join with the paths of its names."""
    return f"""
WITH {crc_table},
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS family, {crc.format(k="conv_id::VARCHAR")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS code FROM said),
own AS (
  SELECT conv_id, code, strlen(text) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {HEAD}), code) AS p FROM coded),
rebuilt AS (
  SELECT c.conv_id, 0 AS half, p, code, size FROM convs c JOIN own ON own.conv_id = c.family AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, code, size FROM convs c JOIN own ON own.conv_id = c.conv_id AND p > h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(code, '') OVER w) AS key, size FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY half, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
steps AS (
  SELECT *, lag(key) OVER w AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n,
    (count(*) - 1) * any_value(size) AS weight, bool_and(last) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM steps GROUP BY key),
below AS (
  SELECT path.key, sum(weight) AS saved, count(*) FILTER (leaf) AS leaves
  FROM node JOIN path ON path.conv_id = node.conv_id AND path.depth <= node.depth GROUP BY path.key),
children AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(n_children, 0) AS n_children,
  leaves AS n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (key) LEFT JOIN children USING (key) LEFT JOIN node up ON up.key = node.parent
"""
