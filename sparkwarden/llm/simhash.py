"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints of eight bytes that differ in at most ``d`` bits differ in at most ``d`` bytes, so they share at least
``8 - d`` bytes at equal positions, the guaranteed minimum. A posting list of single bytes would hold one 256th of all
fingerprints, so a list stands for ``7 - d`` positions together, one byte short of the minimum. Not all such choices are
listed, only so many that any ``d`` positions are left out together by one of them (``choices``; for two bits about a
dozen of 56): the pair agrees in the positions of that list. Pairs that meet are tallied over all eight positions;
those below the minimum, which share the list's bytes only, go, and the rest is verified by the differing bits, all
inside the join, so that only links leave it. Only different fingerprints enter the index; copies meet in their fingerprint.

Words are runs of anything but space and the controls 9 to 13, after lower-casing A-Z. Null texts are empty; a text
without words has fingerprint zero and links like any other. A null id takes part but never names a component. Repeated
rows get equal results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.llm.common import cut, lookup, with_columns
from sparkwarden.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the whole text over word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, CHUNK):
        raw = b"".join([digest(whole[i:j], SEED) for i, j in zip(first[k : k + CHUNK], last[k : k + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, shingle: int = 3, text: str = "text", into: str = "fp") -> DataFrame:
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text)
        return [pa.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))], pa.int64())]

    return with_columns(df, [T.StructField(into, T.LongType())], run)


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _tally(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    parts = [F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)]
    return sum(parts[1:], parts[0])


def choices(most_bits: int) -> list[tuple[int, ...]]:
    """Sets of positions such that two fingerprints within ``most_bits`` bits agree in all positions of at least one.

    Each set leaves out one position more than can differ; sets are added until any ``most_bits`` positions are left out
    together, each time the one that leaves out most choices not met so far.
    """
    width = max(1, 7 - most_bits)
    open_ = [frozenset(c) for c in combinations(range(8), most_bits)]
    out = []
    while open_:
        best = max(combinations(range(8), 8 - width), key=lambda left_out: sum(c <= set(left_out) for c in open_))
        open_ = [c for c in open_ if not c <= set(best)]
        out.append(tuple(p for p in range(8) if p not in best))
    return out


def candidates(prints: DataFrame, most_bits: int) -> DataFrame:
    """``(a, b)`` with ``a < b``, once for each list of the index in which the two fingerprints meet."""
    lists = [
        F.struct(F.lit(i).cast("byte").alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key"))
        for i, p in enumerate(choices(most_bits))
    ]
    index = prints.select("fp", F.explode(F.array(*lists)).alias("x")).select("fp", "x.list", "x.key")
    a, b = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    same = (a["list"] == b["list"]) & (a["key"] == b["key"])
    return a.join(b, same & (F.col("a") < F.col("b"))).select("a", "b")


def links(prints: DataFrame, most_bits: int = 2) -> DataFrame:
    """``(a, b)`` with ``a < b``: different values of ``prints.fp`` that differ in at most ``most_bits`` bits.

    A pair may come from several lists. ``most_bits`` is 0 to 7; at 8 no shared byte would be guaranteed.
    """
    if not 0 <= most_bits < 8:
        raise ValueError("most_bits must be 0 to 7")
    counted = _tally(F.col("a"), F.col("b")) >= 8 - most_bits
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits
    return candidates(prints, most_bits).where(counted & verified)


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs(doc_id, text)``; the component is its smallest id."""
    marked = cut(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    group = components(links(prints.select("fp"), most_bits)).select(F.col("node").alias("fp"), "component")
    rooted = prints.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    rooted = cut(rooted)
    named = cut(rooted.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = cut(rooted.join(named, "component").select("fp", "component_id"))
    return lookup(marked, named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, most_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows of that same id all stay, and so do
    rows with a null id."""
    found = near_duplicates(docs, shingle, most_bits)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti")
