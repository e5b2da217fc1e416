"""Hierarchical multi-length packing of tokenized documents.

Every document becomes its tokens and an end id. Full windows of the longest size are cut off its front; what is left is
routed to the tier of the smallest window that holds it. Tiers are packed from the longest window down: documents of the
tier by best fit, decreasing; then the gaps of its windows are filled with whole documents of shorter tiers, and what
still is open with the front of a shorter document, whose rest goes on to its own tier. So every window is full, and the
few tokens left at the end of a task's rows are laid out in windows of falling powers of two: nothing is padded.
Windows of one tier form step groups of ``group_tokens`` tokens each, so that all full steps cost the same.

Each task packs its own rows in one pass with a bounded buffer; nothing is shuffled. A retried task gives the same rows,
as long as the input's partitions are stable (files, or a written table); ``sequence_id`` starts with the partition.
Null texts are empty documents of one token, the end id; null ids are carried along. Repeated rows are documents of
their own. An empty table gives no row.
"""

from __future__ import annotations

import functools
import json
import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkwarden.llm.common import give_back

WINDOWS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 1 << 21
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "window_tokens long, step_group long"
)
# How a byte-level tokenizer file splits a text before it merges, and white space beside white space.
_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]{2}"
#: The same split for texts where no white space stands beside another: it never looks ahead.
_NARROW_SPLIT = _SPLIT.replace(r"\s+(?!\S)|\s+", r"\s")
#: Characters of a run without white space from which a text is left to the file's own library.
LONG_RUN = 1_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as bytes with their ids, if ids are in the order of the merges; else none."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or file.get("normalizer") or {k: split.get(k) for k in known} != known:
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocab, byte_of = model["vocab"], _byte_of()
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    first = len(vocab) - len(made)
    if first != 256 or any(vocab.get(x) != first + i for i, x in enumerate(made)):
        return None
    return {bytes(byte_of[c] for c in x): i for x, i in vocab.items()}


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, from a byte-level BPE file of the ``tokenizers`` library.

    If the file's ids are in the order of its merges, they are also ranks, and ``tiktoken`` merges by them several times as
    fast. Texts that hold strings of added tokens or a very long run without white space, and other files, go through the
    file's own library.
    """

    def __init__(self, path: str):
        # a task has one core; the library's own threads would each keep caches and memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = None
        if ranks := merge_ranks(path):
            from tiktoken import Encoding

            self.by_rank = [Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_NARROW_SPLIT, _SPLIT)]

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        if self.by_rank is None:
            ways = [self._plain] * len(texts)
        else:
            narrow, wide = (e.encode_ordinary for e in self.by_rank)
            odd = pc.match_substring_regex(texts, rf"\S{{{LONG_RUN}}}")
            for t in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, t))
            has_wide = pc.match_substring_regex(texts, _WIDE)
            ways = [self._plain if o else wide if w else narrow for o, w in zip(odd.to_pylist(), has_wide.to_pylist(), strict=True)]
        for way, text in zip(ways, texts, strict=True):
            yield np.array(way(text.as_py()), "<u4").tobytes()


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker, which lives on from task to task."""
    return Encoder(path)


class _Tiers:
    """Pieces ``(tokens, document, start)`` that wait for a window, by tier."""

    def __init__(self, windows: tuple[int, ...]):
        self.windows = windows
        self.waiting: dict[int, list[tuple[int, int, int]]] = {w: [] for w in windows}
        self.tokens = 0

    def add(self, size: int, doc: int, start: int) -> None:
        self.waiting[self.windows[bisect_left(self.windows, size)]].append((size, doc, start))
        self.tokens += size

    def pack(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows as ``(window, pieces)``; with ``last`` also all that is left."""
        for window in reversed(self.windows):
            yield from self._tier(window)
        if last:
            rest = sorted(x for w in self.windows for x in self.waiting[w])
            for w in self.windows:
                self.waiting[w] = []
            total = self.tokens
            while total:
                window = min(1 << (total.bit_length() - 1), self.windows[-1])
                pieces = []
                yield window, self._cut(rest, window, pieces)
                total -= window
            self.tokens = 0

    @staticmethod
    def _cut(rest: list[tuple[int, int, int]], room: int, pieces: list) -> list:
        """Take exactly ``room`` tokens off the end of ``rest``."""
        while room:
            size, doc, start = rest.pop()
            take = min(size, room)
            pieces.append((take, doc, start))
            if take < size:
                rest.append((size - take, doc, start + take))
            room -= take
        return pieces

    def _tier(self, window: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        own = sorted(self.waiting[window], reverse=True)
        self.waiting[window] = []
        bins: list[list[tuple[int, int, int]]] = []
        gaps: list[tuple[int, int]] = []  # (room, bin), sorted
        for piece in own:
            at = bisect_left(gaps, (piece[0], -1))
            if at < len(gaps):
                room, b = gaps.pop(at)
            else:
                room, b = window, len(bins)
                bins.append([])
            bins[b].append(piece)
            if room > piece[0]:
                insort(gaps, (room - piece[0], b))
        shorter = sorted(x for w in self.windows if w < window for x in self.waiting[w])
        open_bins = []
        for room, b in reversed(gaps):
            while room and shorter:
                at = bisect_left(shorter, (room + 1,)) - 1
                if at < 0:  # nothing fits whole: the front of the shortest does
                    size, doc, start = shorter.pop(0)
                    bins[b].append((room, doc, start))
                    insort(shorter, (size - room, doc, start + room))
                    room = 0
                else:
                    piece = shorter.pop(at)
                    bins[b].append(piece)
                    room -= piece[0]
            if room:
                open_bins.append((b, room))
        for w in self.windows:
            if w < window:
                self.waiting[w] = []
        for piece in shorter:
            self.waiting[self.windows[bisect_left(self.windows, piece[0])]].append(piece)
        # without shorter documents, the emptiest windows give their pieces to the others
        still_open = {b for b, _ in open_bins}
        for b, pieces in enumerate(bins):
            if b not in still_open:
                self.tokens -= window
                yield window, pieces
        rest = [p for b in still_open for p in bins[b]]
        held = sum(p[0] for p in rest)
        while held >= window:
            self.tokens -= window
            held -= window
            yield window, self._cut(rest, window, [])
        for size, doc, start in rest:
            self.waiting[self.windows[bisect_left(self.windows, size)]].append((size, doc, start))


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    windows: tuple[int, ...] = WINDOWS,
    end_id: int = END_ID,
    group_tokens: int = 32_768,
) -> DataFrame:
    """Pieces of packed sequences of ``docs(doc_id, text)``, see the module; ``ids`` are 32-bit little-endian.

    ``windows`` are rising powers of two.
    """
    longest = windows[-1]
    if list(windows) != sorted(set(windows)) or any(w & (w - 1) for w in windows):
        raise ValueError("windows must be rising powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        base = TaskContext.get().partitionId() << 36
        words = encoder(tokenizer_file)
        tiers, texts = _Tiers(windows), {}
        end = np.array([end_id], "<u4").tobytes()
        made = 0
        steps: dict[int, int] = defaultdict(int)  # windows of a tier so far
        out: list[tuple] = []

        def emit(window: int, pieces: list[tuple[int, int, int]]) -> None:
            nonlocal made
            # the tier in the low bits keeps groups of different tiers apart
            group = base | (steps[window] // max(1, group_tokens // window)) << 8 | window.bit_length()
            steps[window] += 1
            offset = 0
            for size, doc, start in pieces:
                doc_id, ids, origin, total = texts[doc]
                at = 4 * (start - origin)
                out.append((doc_id, start, size, ids[at : at + 4 * size], total, base | made, offset, window, group))
                offset += size
            made += 1

        def rows() -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            for k in range(0, len(out), 2000):
                columns = zip(*out[k : k + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            out.clear()

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        seen = 0
        for batch in batches:
            ids_of = words.encode(pc.fill_null(batch.column("text"), ""))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids += end
                start, left = 0, len(ids) // 4
                texts[seen] = (doc_id, ids, 0, left)
                while left >= longest:
                    emit(longest, [(longest, seen, start)])
                    start, left = start + longest, left - longest
                texts[seen] = (doc_id, ids[4 * start :], start, len(ids) // 4)
                if left:
                    tiers.add(left, seen, start)
                else:
                    del texts[seen]
                seen += 1
                if tiers.tokens >= BUFFER_TOKENS:
                    for window, pieces in tiers.pack(last=False):
                        emit(window, pieces)
                    waiting = {doc for w in windows for _, doc, _ in tiers.waiting[w]}
                    texts = {k: v for k, v in texts.items() if k in waiting}
            yield from rows()
        for window, pieces in tiers.pack(last=True):
            emit(window, pieces)
        yield from rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
