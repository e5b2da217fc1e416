"""Fuzzy line deduplication: MinHash bands, exact Jaccard checks, distributed union-find, one line kept per component.

Lines are compared lower-cased with white space runs as one space; a line's shingles are its distinct runs of ``shingle``
characters, or the whole line if it is shorter. Two different lines link if the Jaccard similarity of their shingles is at
least ``similarity``. Lines that are equal after that folding are one line from the start.

1. One pass makes ``(row, line, hash, bands)``; bands stand only where a line appears first in a batch.
2. Lines that share a band key are candidates. Keys and hashes travel in arrays, one row for those of many lines that go to one
   bucket of keys, as bytes, and a task sorts its buckets' arrays. Each line is first paired with one line of its key, so that there are
   fewer pairs than band keys, however many lines a key has.
3. Candidates' texts are read again, and Jaccard similarity is computed exactly, from arrays of shingle hashes. The links
   give components; a near-copy group usually is one already.
4. What is left are pairs inside a key whose lines are in different components. Keys with few lines give these pairs. In a key
   with many, lines lie in blocks ordered by component, bounded in lines and characters; blocks of one and the same component
   need no comparison, and each other pair of blocks is a group of its own, whose common shingles are a matrix product.
5. Components of all links keep the line that stands first by ``(doc_id, row, line)``; all others are removed.

Only hashes are shuffled for all lines; texts only for candidates. To find them again, the second pass uses a bit map of
fixed size; when it fills up, more lines are joined, with the same result.

Blank lines are never removed. Null and empty texts stay as they are. A document whose lines all stand elsewhere keeps its
row with an empty text. Rows that agree in id and text are one document and are treated alike. Null ids come first.
Lines are told apart by a 64-bit hash of their folded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, free_name, lookup
from sparkwarden.llm.components import components
from sparkwarden.llm.textfeat import mix

SHINGLE = 6
SIMILARITY = 0.8
BANDS, ROWS = 12, 5  # at similarity 0.8 a pair shares a band with probability 0.99
#: Lines of one key that give pairs; more give blocks of at most so many lines and, beyond the first line, characters.
FEW = 32
BLOCK, BLOCK_CHARS = 256, 1 << 18
MAP_BITS = 1 << 26
#: Characters whose signatures are made together, so that they stay in a core's cache; it changes no signature.
SLICE_CHARS = 1 << 16
#: Characters of pairs that are checked together, and shingles that are compared together.
CHECK_CHARS, CHECK_SHINGLES = 1 << 18, 1 << 18
#: Columns of the matrix that compares blocks.
COLUMNS = 2048
#: Band keys that are dealt to buckets together, and band keys that one task is to sort; it has some buckets, so that tasks are even.
DEAL_KEYS, TASK_KEYS, TASK_BUCKETS = 1 << 19, 1 << 19, 4
#: White space but for the space and the line feed.
ODD_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_RNG = np.random.default_rng(11)
_TERMS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_TIMES = (_RNG.integers(1, 2**31, 1024, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIPS = _RNG.integers(0, 2**32, 1024, dtype=np.uint32)


def fold(line: str) -> str:
    low = line.lower()
    # the only white space that is printable is the space
    if low.isprintable() and "  " not in low and not low.startswith(" ") and not low.endswith(" "):
        return low
    return " ".join(low.split())


def folded_lines(text: str) -> list[str]:
    """Each line of ``text`` as :func:`fold` gives it; a text without odd white space is lower-cased and cut as a whole."""
    low = text.lower()
    if "  " in low or any(c in low for c in ODD_SPACE):
        return [" ".join(x.split()) for x in low.split("\n")]
    return [x.strip(" ") for x in low.split("\n")]


def line_hash(folded: str) -> int:
    value = xxhash.xxh64_intdigest(folded.encode("utf-8", "replace"))
    return value - (1 << 64) if value >= 1 << 63 else value


def shingles(folded: str, size: int) -> set[str]:
    return {folded[i : i + size] for i in range(max(1, len(folded) - size + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of folded, non-empty lines, one line after the other, and their number per line."""
    padded = [x.ljust(size, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    whole = max(0, len(codes) - size + 1)
    h = codes[:whole] * _TERMS[0]
    term = np.empty_like(h)
    for j in range(1, size):
        h += np.multiply(codes[j : j + whole], _TERMS[j % 64], out=term)
    inside = np.ones(whole, bool)  # but for those that reach into the next line
    inside[(np.cumsum(lengths)[:-1, None] - np.arange(1, size)).ravel()] = False
    return mix(h[inside]), lengths - size + 1


def band_keys(lines: list[str], size: int, bands: int, rows: int) -> np.ndarray:
    """``(len(lines), bands)`` keys of the MinHash signatures of folded, non-empty lines."""
    out = np.empty((len(lines), bands), np.int64)
    k = 0
    while k < len(lines):
        part, chars = [], 0
        while k + len(part) < len(lines) and (not part or chars < SLICE_CHARS):
            part.append(lines[k + len(part)])
            chars += len(part[-1])
        h, counts = shingle_hashes(part, size)
        first = np.cumsum(counts) - counts
        h32 = (h >> np.uint64(32)).astype(np.uint32)
        turned, least = np.empty_like(h32), np.empty((bands * rows, len(part)), np.uint64)
        for r in range(bands * rows):
            np.multiply(h32, _TIMES[r], out=turned)
            np.bitwise_xor(turned, _FLIPS[r], out=turned)
            least[r] = np.minimum.reduceat(turned, first)
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(part), axis=1)
        for r in range(rows):  # of all bands at once
            key = mix(key * np.uint64(31) + least[r::rows])
        out[k : k + len(part)] = key.view(np.int64).T
        k += len(part)
    return out


class ShingleSets:
    """The distinct shingles of some lines, as sorted hashes.

    A line's number stands in the upper bits of what is sorted, and that of a pair when two lines are compared, so that one
    sort serves all; the hashes give up as many of their 64 bits, some ten to fifteen.
    """

    def __init__(self, lines: list[str], size: int):
        h, counts = shingle_hashes(lines, size)
        marked = _marked(np.repeat(np.arange(len(lines)), counts), h, len(lines))
        marked.sort()
        marked = marked[np.append(True, marked[1:] != marked[:-1])]
        bits = np.uint64(len(lines).bit_length())
        self.hashes = marked << bits
        self.counts = np.bincount((marked >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(lines))
        self.starts = np.cumsum(self.counts) - self.counts

    def alike_blocks(self, a: slice, b: slice, similarity: float) -> np.ndarray:
        """Which lines of ``a`` have a Jaccard similarity of at least ``similarity`` with which lines of ``b``, as a matrix; it says
        nothing of a line and itself."""
        order = np.argsort(self.hashes)
        line, h = np.repeat(np.arange(len(self.counts)), self.counts)[order], self.hashes[order]
        number = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        shared = np.bincount(number) > 1  # others are common to no two lines
        line, number = line[shared[number]], (np.cumsum(shared) - 1)[number[shared[number]]]
        cuts = np.searchsorted(number, np.arange(0, np.count_nonzero(shared) + COLUMNS, COLUMNS))
        sizes, others = self.counts[a][:, None], self.counts[b][None, :]
        common = np.zeros((sizes.shape[0], others.shape[1]))
        for k in range(len(cuts) - 1):
            has = np.zeros((len(self.counts), COLUMNS), np.float32)
            has[line[cuts[k] : cuts[k + 1]], number[cuts[k] : cuts[k + 1]] - k * COLUMNS] = 1
            common += has[a] @ has[b].T
        fits = np.minimum(sizes, others) >= similarity * np.maximum(sizes, others)
        return fits & (common / (sizes + others - common) >= similarity)

    def alike(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Which pairs of lines have a Jaccard similarity of at least ``similarity``."""
        out = np.zeros(len(a), bool)
        few, many = np.minimum(self.counts[a], self.counts[b]), np.maximum(self.counts[a], self.counts[b])
        near = np.flatnonzero(few >= similarity * many)  # others differ too much in size alone
        ends = np.cumsum((few + many)[near])
        k = 0
        while k < len(near):
            n = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHECK_SHINGLES, "right")))
            x, y = a[near[k:n]], b[near[k:n]]
            both = np.concatenate([x, y])
            sizes = self.counts[both]
            at = np.arange(sizes.sum()) + np.repeat(self.starts[both] - (np.cumsum(sizes) - sizes), sizes)
            seen = _marked(np.repeat(np.tile(np.arange(n - k), 2), sizes), self.hashes[at], n - k)
            seen.sort()
            twice = seen[1:][seen[1:] == seen[:-1]] >> np.uint64(64 - (n - k).bit_length())
            common = np.bincount(twice.astype(np.int64), minlength=n - k)
            out[near[k:n]] = common / (self.counts[x] + self.counts[y] - common) >= similarity
            k = n
        return out


def _marked(number: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """``h`` with ``number``, which is below ``most``, in place of its lowest bits, but on top."""
    bits = np.uint64(most.bit_length())
    return (number.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)


def _as_bytes(run, *names: str):
    """``run`` with its columns ``names``, arrays of longs, as bytes: Spark copies these whole, an array value by value."""

    def packed(lists: pa.ListArray) -> pa.Array:
        ends = pa.py_buffer((lists.offsets.to_numpy() * 8).astype(np.int32))
        valid = lists.is_valid().buffers()[1] if lists.null_count else None
        return pa.Array.from_buffers(pa.binary(), len(lists), [valid, ends, pa.py_buffer(lists.values.to_numpy())])

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            columns = [packed(c) if n in names else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return packing


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All longs of a column of arrays, or of their bytes, and their number per row."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[0] == ends[-1]:
        return np.empty(0, np.int64), np.zeros(len(column), np.int64)
    return np.frombuffer(column.buffers()[2], np.int64, (ends[-1] - ends[0]) // 8, ends[0]), np.diff(ends) // 8


def _lines(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, hashes, new = [], [], [], {}
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, folded in enumerate(folded_lines(text or "")):
                    if folded:
                        h = line_hash(folded)
                        if h not in new:
                            new[h] = (len(at), folded)
                        at.append(i)
                        no.append(n)
                        hashes.append(h)
            keys = band_keys([x for _, x in new.values()], size, bands, rows)
            where = np.full(len(at), -1)
            where[[k for k, _ in new.values()]] = np.arange(len(new))
            told = where >= 0
            ends = np.concatenate([[0], np.cumsum(told * bands)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[where[told]].ravel()), mask=pa.array(~told))
            rows_of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows_of),
                    batch.column("row").take(rows_of),
                    pa.array(no, pa.int32()),
                    pa.array(hashes, pa.int64()),
                    column,
                ],
                names=["doc_id", "row", "line", "h", "bands"],
            )

    return run


def _dealt(buckets: int):
    """Band keys and their lines in arrays, one row for each bucket of keys."""

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, h = np.concatenate([k for k, _ in held]), np.concatenate([h for _, h in held])
        # numpy sorts numbers of 16 bits by their digits
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(sizes)
        bounds = pa.array(np.append(0, np.cumsum(sizes[some])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (keys, h)]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], names=["bucket", "keys", "hs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, each = _longs(batch.column("bands"))
            held.append((keys, np.repeat(batch.column("h").to_numpy(), each)))
            if sum(len(k) for k, _ in held) >= DEAL_KEYS:
                yield deal(held)
                held = []
        if sum(len(k) for k, _ in held):
            yield deal(held)

    return run


def _with_first(most: int):
    """Of band keys in arrays: ``(key, a, b)``, each further line of a key with the one that comes first.

    Whenever more than ``most`` keys have come in, all but the first line of each key are given out, so that a task never holds all
    lines of a frequent key."""

    def paired(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], pa.RecordBatch]:
        k, h = np.concatenate([k for k, _ in held]), np.concatenate([h for _, h in held])
        order = np.argsort(k)
        k = k[order]
        starts = np.append(True, k[1:] != k[:-1])
        first = h[np.minimum.reduceat(order, np.flatnonzero(starts))]  # a line that was kept stands before the new ones
        firsts, others = first[np.cumsum(starts) - 1], h[order]
        more = others != firsts
        out = [pa.array(x[more]) for x in (k, firsts, others)]
        return (k[starts], first), pa.RecordBatch.from_arrays(out, names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = [], 0
        for batch in batches:
            held.append((_longs(batch.column("keys"))[0], _longs(batch.column("hs"))[0]))
            new += len(held[-1][0])
            if new > most:
                kept, out = paired(held)
                held, new = [kept], 0
                yield out
        if new:
            yield paired(held)[1]

    return run


def _in_blocks(most: int, most_chars: int):
    """A number for the block of each row, of rows sorted by key and component with the lines' ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, rows, chars = TaskContext.get().partitionId() << 40, None, 0, 0
        for batch in batches:
            out = []
            for k, size in zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if k != key or rows == most or (rows and chars + size > most_chars):
                    number, key, rows, chars = number + 1, k, 0, 0
                rows, chars = rows + 1, chars + size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "block"])

    return run


def _bit(h: np.ndarray) -> np.ndarray:
    return (mix(h.view(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit map of fixed size that has the bits of all hashes."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], names=["word", "bits"])

    words = hashes.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(MAP_BITS >> 5, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _texts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(h, folded)`` of the lines in ``hashes(h)``."""
    held = docs.sparkSession.sparkContext.broadcast(_bit_map(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = list({f for t in batch.column("text").to_pylist() if t for f in folded_lines(t) if f})
            h = np.fromiter(map(line_hash, folded), np.int64, len(folded))
            at = _bit(h)
            hit = np.flatnonzero(held.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[hit]), pa.array([folded[i] for i in hit.tolist()], pa.string())], names=["h", "folded"]
            )

    found = docs.select("text").mapInArrow(run, "h long, folded string")
    return found.join(hashes, "h", "left_semi").groupBy("h").agg(F.min("folded").alias("folded"))


def _check_pairs(size: int, similarity: float):
    """Pairs ``(a, b)`` with their texts ``x`` and ``y``; a line that a batch holds several times is taken apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ends = np.cumsum(pc.add(pc.utf8_length(x), pc.utf8_length(y)).to_numpy().astype(np.int64))
            k = 0
            while k < batch.num_rows:
                n = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHECK_CHARS, "right")))
                texts = pa.concat_arrays([x.slice(k, n - k), y.slice(k, n - k)]).dictionary_encode()
                code = texts.indices.to_numpy()
                good = ShingleSets(texts.dictionary.to_pylist(), size).alike(code[: n - k], code[n - k :], similarity)
                yield batch.select(["a", "b"]).slice(k, n - k).filter(pa.array(good))
                k = n

    return run


def _check_blocks(size: int, similarity: float):
    """Links between lines of different components, in groups of at most two blocks; rows are sorted by group."""

    def links(rows: list[tuple[int, int, int, str]], two: bool) -> pa.RecordBatch:
        block, h, component = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        # if two blocks meet, each line of the second against those of the first, else against those before it
        second = int(np.searchsorted(block, block[-1])) if two else 0
        others = slice(0, second or len(rows))
        good = ShingleSets([r[3] for r in rows], size).alike_blocks(slice(second, len(rows)), others, similarity)
        found: tuple[list[int], list[int]] = [], []
        new = good & (component[others] != component[second:, None])  # components only become fewer
        for i in (second + np.flatnonzero(new.any(axis=1))).tolist():
            before = second or i
            hit = np.flatnonzero(good[i - second, :before] & (component[:before] != component[i]))
            for j in hit[np.unique(component[hit], return_index=True)[1]]:
                found[0].append(int(h[j]))
                found[1].append(int(h[i]))
                component[component == component[j]] = component[i]
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            columns = ("key", "i", "j", "block", "h", "component", "folded")
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (key, i, j) != group:
                    if rows:
                        yield links(rows, group[1] != group[2])
                    group, rows = (key, i, j), []
                rows.append(row)
        if rows:
            yield links(rows, group[1] != group[2])

    return run


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links among ``pairs(a, b)``, a written table."""
    side, other = (texts.select(F.col("h").alias(h), F.col("folded").alias(t)) for h, t in (("a", "x"), ("b", "y")))
    both = lookup(pairs, side, "a").join(other, "b")
    return both.select("a", "b", "x", "y").mapInArrow(_check_pairs(shingle, similarity), "a long, b long")


def _block_tasks(large: DataFrame) -> DataFrame:
    """``(key, i, j, block, h, component, size)``: each pair of blocks of a key that may hold a new link, with the lines of both."""
    order = ["key", "component", "h"]
    ranged = large.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "h", "component", "size")
    placed = cut(ranged.mapInArrow(_in_blocks(BLOCK, BLOCK_CHARS), "key long, h long, component long, size int, block long"))
    # a block's component, if it has but one; the one that most blocks of a key have is compared with the others only
    blocks = placed.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = cut(blocks.withColumn("pure", F.when(F.col("low") == F.col("high"), F.col("low"))))
    common = blocks.where("pure IS NOT NULL").groupBy("key", "pure").agg(F.count("*").alias("n"))
    common = common.groupBy("key").agg(F.max_by("pure", F.struct("n", "pure")).alias("main"))
    rare = blocks.join(common, "key", "left").where("main IS NULL OR NOT (pure <=> main)")
    rare = rare.select("key", F.col("block").alias("one"), F.col("pure").alias("own"))
    meet = rare.join(blocks.select("key", F.col("block").alias("two"), "pure"), "key")
    # a pair of two rare blocks comes twice; a block of several components also meets itself
    meet = meet.where("CASE WHEN one = two THEN own IS NULL ELSE NOT coalesce(own = pure, false) END")
    meet = meet.select("key", F.least("one", "two").alias("i"), F.greatest("one", "two").alias("j")).distinct()
    ends = meet.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return ends.join(placed, ["key", "block"])


def line_links(docs: DataFrame, lines: DataFrame, shingle: int, similarity: float, bands: int = BANDS) -> DataFrame:
    """Links ``(a, b)`` of line hashes that connect what similar lines connect."""
    firsts = lines.where("bands IS NOT NULL").select("h", "bands")
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() * bands // TASK_KEYS))
    deal = _as_bytes(_dealt(tasks * TASK_BUCKETS), "keys", "hs")
    dealt = firsts.mapInArrow(deal, "bucket int, keys binary, hs binary")
    # which line of a key comes first changes no component
    found = cut(dealt.repartition(tasks, "bucket").mapInArrow(_with_first(TASK_KEYS), "key long, a long, b long"))
    pairs = cut(found.select("a", "b").distinct())
    hashes = cut(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    texts = cut(_texts(docs, hashes))
    links = cut(_checked(pairs, texts, shingle, similarity))

    # pairs of further lines of a key that these links don't connect
    named = found.select("key", F.col("b").alias("h")).join(components(links).withColumnRenamed("node", "h"), "h", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "h")))
    spread = (F.min("component") != F.max("component")).alias("open")
    rest = lookup(named, named.groupBy("key").agg(spread, F.count("*").alias("n")).where("open"), "key").where("open")
    rest = cut(rest.join(texts.select("h", F.length("folded").alias("size")), "h").select("key", "h", "component", "size", "n"))
    one, two = (rest.where(F.col("n") <= FEW).select("key", F.col("h").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    more = one.join(two, "key").where("a < b AND of_a <> of_b").select("a", "b").distinct()
    more = _checked(cut(more.join(pairs, ["a", "b"], "left_anti")), texts, shingle, similarity)
    tasks = _block_tasks(rest.where(F.col("n") > FEW)).join(texts, "h")
    tasks = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "h")
    tasks = tasks.select("key", "i", "j", "block", "h", "component", "folded")
    blocks = tasks.mapInArrow(_check_blocks(shingle, similarity), "a long, b long")
    return links.unionByName(more).unionByName(blocks)


def _removed(plain: DataFrame, shingle: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """``(row, removed)``: the line numbers to remove, for the rows of ``plain(doc_id, text, row)`` that lose any."""
    found = _as_bytes(_lines(shingle, bands, rows), "bands")
    lines = cut(plain.mapInArrow(found, "doc_id long, row long, line int, h long, bands binary"))
    group = components(line_links(plain, lines, shingle, similarity, bands)).select(F.col("node").alias("h"), "component")
    place = F.struct("doc_id", "row", "line")
    firsts = lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.join(group, "h", "left").where("component IS NOT NULL OR n > 1"))
    firsts = firsts.withColumn("component", F.coalesce("component", "h"))
    keepers = cut(firsts.groupBy("component").agg(F.min("first").alias("keeper")))
    keepers = cut(firsts.join(keepers, "component").select("h", "keeper"))
    extra = lines.join(keepers, "h").where(~place.eqNullSafe(F.col("keeper"))).select("row", "line")
    return cut(extra.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("removed")))


def dedup_lines(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    report: bool = True,
) -> DataFrame:
    """``docs(doc_id, text, ...)`` without repeated lines, with all its columns; ``n_chars``, if there, is counted anew.

    With ``report`` three columns are added, in place of older ones of these names: ``n_lines`` of the text as it was,
    ``removed``, the numbers of the lines that are gone, from 0, and ``n_removed``.
    """
    row, gone = free_name(docs, "row"), free_name(docs, "removed")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    drop = _removed(keyed.select("doc_id", "text", F.col(row).alias("row")), shingle, similarity, bands, rows)
    # the line numbers of a partition's rows are few beside its texts, which are not to be sorted
    found = drop.select(F.col("row").alias(row), F.col("removed").alias(gone)).hint("shuffle_hash")
    out = keyed.join(found, row, "left").drop(row)
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda _, i: ~F.array_contains(gone, i))
    if report:
        listed = F.coalesce(gone, F.array().cast("array<int>"))
        ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        n_lines = F.coalesce(ends + 1, F.lit(0))
        out = out.withColumns({"n_lines": n_lines, "n_removed": F.size(listed), "removed": listed})
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    keep = docs.columns + ([c for c in ("n_lines", "n_removed", "removed") if c not in docs.columns] if report else [])
    return out.select(keep)
