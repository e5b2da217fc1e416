"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

BPE is decided by pairs: a sequence of pieces is the encoding of its text if and only if each two neighbours are the
encoding of theirs. So every prefix of a text has exactly one possible last piece, and that of a longer prefix is the
one piece that ends there and is compatible with the last piece of what stands before it. An Aho-Corasick automaton
over the vocabulary lists the pieces that end at each character, longest first; the first that passes the test is
stored; at the end the table is walked backwards. The time is linear in the text, however long its words are.

Pairs are tested by merging their own characters, the best-ranked and leftmost pair first, and remembered. No piece
holds a space mark after another character, so that texts are cut before each run of marks; distinct parts are encoded
once per task and remembered up to a bound. Characters without a piece become their bytes.

Null texts are empty: begin and end ids only. Repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkwarden.llm.common import with_columns

MARK = "▁"
#: Parts of texts, and pairs of pieces, that a task remembers.
CACHE_PARTS = 400_000
CACHE_PAIRS = 1_000_000
#: Characters that are cut into parts together.
GROUP_CHARS = 1 << 20
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceEncoder:
    """Encoder and decoder of one ``.model`` file with a BPE vocabulary, identity normalizer and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        plain = [
            i
            for i in range(size)
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))
        ]
        self.text = {i: self.library.id_to_piece(i) for i in plain}
        self.ids = {t: i for i, t in self.text.items()}
        self.score = {t: self.library.get_score(i) for t, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            # a piece that its own characters don't merge to never stands in an encoding
            if self._merge(t) == [t]:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay these two."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.text[left], self.text[right]
            known = self._merge(a + b) == [a, b]
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _table(self, part: str) -> bytes:
        """Ids of one part: the prefix table forwards, the ids backwards."""
        n = len(part)
        last = [-1] * (n + 1)  # the last piece of each prefix; -1: a character without a piece
        length = [1] * (n + 1)
        done, pairs = 0, self.pairs
        for end, (piece, size) in self.automaton.iter(part):
            end += 1
            if end == done:
                continue
            start = end - size
            before = last[start]
            if before >= 0 and start:
                fits = pairs.get((before, piece))
                if fits is None:
                    fits = self._fits(before, piece)
                if not fits:
                    continue
            last[end], length[end], done = piece, size, end
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.bytes[b] for b in reversed(part[at - 1].encode())]
            at -= length[at]
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids with begin and end ids, as little-endian 32-bit bytes."""
        head, tail = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        group: list[list[str]] = []
        size = 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            marked = MARK + text.replace(" ", MARK) if text else ""
            group.append(_PARTS.findall(marked) if MARK * 2 in marked else [MARK + x for x in marked.split(MARK)[1:]])
            size += len(text)
            if size > GROUP_CHARS:
                yield from self._group(group, head, tail)
                group, size = [], 0
        yield from self._group(group, head, tail)

    def _group(self, group: list[list[str]], head: bytes, tail: bytes) -> Iterator[bytes]:
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        known, table = self.parts, self._table
        for parts in group:
            for part in parts:
                if part not in known:
                    known[part] = table(part)
            yield head + b"".join(map(known.__getitem__, parts)) + tail

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file, built once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_pieces(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of each row's whole text as 32-bit little-endian binary, and their decoded text if named."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(model_file)
        made = list(enc.encode(pc.fill_null(batch.column(text), "")))
        out = [pa.array(made, pa.binary())]
        return out + [pa.array([enc.decode(x) for x in made], pa.string())] if decoded else out

    fields = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return with_columns(df, fields, run)
