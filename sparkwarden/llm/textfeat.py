"""Words of an Arrow batch of texts as arrays: 64-bit word hashes and the row each word stands in.

Everything works on the batch's byte buffer at once; there is no loop over words. Upper case is folded first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Letters, digits and every byte of a character beyond ASCII belong to words.
WORD_BYTES = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
#: Every byte but white space belongs to a word.
SOLID_BYTES = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bytes of text that are handled at once; bounds the work arrays.
SLICE_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and the ``len + 1`` offsets of the rows in them; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range by itself."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def hash_spans(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; ``inside`` marks the bytes of the spans, which don't touch each other's."""
    if not len(starts):
        return np.empty(0, np.uint64)
    held = data[inside]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(held)) - np.repeat(first, lengths)
    terms = _BYTE[held] * _PLACE[place & 63]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(inside, starts, ends, row)`` of the maximal runs of member bytes, cut at row ends."""
    inside = member[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return inside, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(texts: pa.Array, member: np.ndarray = WORD_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, word hashes, row of each word)`` for slices of the batch, in order."""
    data, offsets = byte_view(pc.utf8_lower(pc.fill_null(texts, "")))
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        inside, starts, ends, row = spans(part, at, member)
        yield a, b, hash_spans(part, inside, starts, ends), row + a
