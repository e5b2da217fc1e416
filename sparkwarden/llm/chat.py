"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, each turn as ``<|turn|>role<|text|>text<|end|>``, and encoded once with offsets. The three
marks are added tokens, so that no token reaches over a mark. A token is under the loss if it meets the text of a turn
whose role is learned: the sorted spans of those texts meet the sorted spans of the tokens by binary search.

Control strings inside roles and texts are escaped by a backslash after their first character, one more than was there
before, which is undone by taking one away. Besides the own marks this covers strings that other templates reserve.

Rows of a conversation are ordered by turn, role and text, nulls first, so that ties and repeated rows have one result.
Null roles and texts are empty. Rows with a null ``conv_id`` are one conversation. A conversation is one text, so that it is
rendered in one task; rows stream through it sorted, and one conversation at a time is held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkwarden.llm.common import with_columns

TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "<|end|>")
LEARNED = ("assistant",)
#: Characters of finished conversations that a task holds.
HELD_CHARS = 1 << 21
# what begins like "<|", "<s>", "</s>", "[INST]" or "[/INST]", with any number of backslashes inside
_PLAIN = re.compile(r"(<)(\\*)(?=\||/?s>)|(\[)(\\*)(?=/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*)(?=\||/?s>)|(\[)\\(\\*)(?=/?INST\])")
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
_INTS = T.ArrayType(T.IntegerType())
FIELDS = [
    T.StructField("formatted", T.StringType()),
    T.StructField("ids", _INTS),
    T.StructField("starts", _INTS),
    T.StructField("ends", _INTS),
    T.StructField("loss", T.ArrayType(T.BooleanType())),
]


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4] or ''}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[1] or m[3]}{m[2] or m[4] or ''}", text)


def render(turns: list[tuple[str | None, str | None]], learned: tuple[str, ...] = LEARNED) -> tuple[str, np.ndarray]:
    """The text of ``(role, text)`` turns and the sorted ``(start, end)`` spans of the learned texts."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
        parts += [head, body, END]
        at += len(head)
        if role in learned and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the tokens, sorted by place, meet one of the sorted spans."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return np.cumsum(steps)[:-1] > 0


def text_under(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped texts of the maximal runs of tokens under the loss."""
    out: list[str] = []
    at = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
    for i, j in zip(at[::2], at[1::2], strict=True):
        out.append(unescape(formatted[starts[i] : ends[j - 1]]))
    return out


def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    # a token's span is to hold its leading space
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def format_conversations(rows: DataFrame, tokenizer_file: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """``(conv_id, formatted, ids, starts, ends, loss)`` for each conversation of ``rows(conv_id, turn, role, text)``."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_file)
        done: list[tuple] = []

        def finish(conv, turns: list) -> None:
            text, spans = render(turns, learned)
            coded = tokenizer.encode(text, add_special_tokens=False)
            at = np.array(coded.offsets, np.int64).reshape(-1, 2)
            done.append((conv, text, coded.ids, at[:, 0].tolist(), at[:, 1].tolist(), loss_mask(at[:, 0], at[:, 1], spans).tolist()))

        def result() -> pa.RecordBatch:
            kinds = [id_type, pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=schema.names
            )
            done.clear()
            return batch

        held: tuple | None = None
        turns: list[tuple[str | None, str | None]] = []
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held is not None and held[0] != conv:
                    finish(held[0], turns)
                    turns = []
                    if sum(len(x[1]) for x in done) > HELD_CHARS or len(done) >= 500:
                        yield result()
                held = (conv,)
                turns.append((role, text))
        if held is not None:
            finish(held[0], turns)
        if done:
            yield result()

    order = ["conv_id", "turn", "role", "text"]
    return rows.select(order).repartition("conv_id").sortWithinPartitions(order).mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the output itself holds: its turns, and the text under its loss mask."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for i in range(batch.num_rows):
            text = batch.column("formatted")[i].as_py()
            starts, ends, loss = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
            turns = parse(text)
            under = "".join(text_under(text, starts, ends, loss))
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, under)]
            out.append((len(turns), digests[0], len(under), digests[1], len(text)))
        columns = zip(*out, strict=True) if out else [()] * 5
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType())
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return with_columns(formatted, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], run)
