"""Re-arming alerts: from candidate rows to the rows that really fire.

A sliding rule fires at row ``k`` when its window, *emptied by the previous firing*, is full enough. Write ``q`` for
the row that must still be in the window: the T-th latest failure, or the last use of the N-th latest port. Then
``k`` fires iff the last firing came before ``q``. So each candidate is an interval ``[q, k]`` and the firings are the
greedy choice of disjoint intervals by right end.

The greedy choice is sequential per key, but a long attack must not sit in one task. Buckets are folded in
parallel: each one reports which last firing it would hand on for every last firing it might receive
(``handover_rows``); those small maps are chained per key (``chain_rows``), and a second fold then emits the firings.
Every fold streams over sorted rows with constant or window-bounded state.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkwarden.operators.timebuckets import bucket_sql

# "No earlier firing that matters": sorts before every (ts, seq).
_NONE = (-(2**63), -(2**63))
# Position label of a handover row that holds for any received firing.
_ANY = (2**63 - 1, 2**63 - 1)

_ENTRY, _HALO, _OWN, _RECEIVED = 0, 1, 2, 3
_ORDER = ("key", "bucket", "ts_us", "event_seq", "kind")


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _values(column):
    return column.to_pylist() if column.null_count or not pa.types.is_integer(column.type) else column.to_numpy().tolist()


def _grouped(batches, group, names):
    """Rows as ``_rows`` gives them, but with the columns of ``group`` as one tuple in front, which is made once for each run of rows
    that agree in them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n) for n in group]
        starts = np.ones(batch.num_rows, bool)
        starts[1:] = np.logical_or.reduce(
            [pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)), True).to_numpy(zero_copy_only=False) for k in keys]
        )
        firsts = pa.array(np.flatnonzero(starts))
        heads = [*zip(*(k.take(firsts).to_pylist() for k in keys))]
        yield from zip(map(heads.__getitem__, (np.cumsum(starts) - 1).tolist()), *(_values(batch.column(n)) for n in names))


def _emit(rows, schema, size=8192):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*chunk), schema)], schema=schema
            )
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*chunk), schema)], schema=schema)


_KEYED = [pa.field("key", pa.string()), pa.field("bucket", pa.int64())]
_HANDOVER_ARROW = pa.schema(
    _KEYED + [pa.field(n, pa.int64()) for n in ("in_ts", "in_seq", "out_ts", "out_seq")]
)
_HANDOVER_DDL = "key string, bucket bigint, in_ts bigint, in_seq bigint, out_ts bigint, out_seq bigint"
_CHAIN_ARROW = pa.schema(_KEYED + [pa.field(n, pa.int64()) for n in ("ts_us", "event_seq")])
_CHAIN_DDL = "key string, bucket bigint, ts_us bigint, event_seq bigint"
_FIRE_ARROW = pa.schema(
    [pa.field("key", pa.string())] + [pa.field(n, pa.int64()) for n in ("ts_us", "event_seq", "prev_ts", "prev_seq")]
)
_FIRE_DDL = "key string, ts_us bigint, event_seq bigint, prev_ts bigint, prev_seq bigint"
_CAND_COLS = ("key", "bucket", "kind", "ts_us", "event_seq", "q_ts", "q_seq")


def handover_rows(rows, limits):
    """Fold of each bucket for all last firings it might receive; ``limits(key)`` gives its window and bucket width.

    ``rows`` are ``(key, bucket, kind, ts, seq, q_ts, q_seq)`` in order, with anything as key. ``live`` holds the possible
    last firings in order, each with the labels (received firings) that lead to it. At a candidate every last firing before ``q`` is replaced by the candidate, so states merge and ``live`` stays as
    short as the number of candidates inside one window.
    """

    def close(key, bucket, live, start):
        if start is None:
            # no own candidates: nothing is handed on
            return
        window_us, bucket_us = limits(key)
        floor_ts = (bucket + 1) * bucket_us - window_us
        outs = [(labels, pos if pos[0] >= floor_ts else _NONE) for pos, labels in live]
        exits = {pos for _, pos in outs}
        if len(exits) == 1:
            only = exits.pop()
            if only != _NONE:
                yield (key, bucket, *_ANY, *only)
            return
        for labels, pos in outs:
            for label in labels:
                yield (key, bucket, *label, *pos)

    def label_states(live, key, bucket):
        """Start of the own part: every possible state becomes a label of itself; stale ones count as none."""
        window_us, bucket_us = limits(key)
        floor_ts = bucket * bucket_us - window_us
        fresh = deque([(_NONE, [_NONE])])
        fresh.extend((pos, [pos]) for pos, _ in live if pos != _NONE and pos[0] >= floor_ts)
        return fresh

    group, live, start, warm = None, None, None, False
    for key, bucket, kind, ts, seq, q_ts, q_seq in rows:
        if group != (key, bucket):
            if group is not None:
                yield from close(*group, live, start)
            group, live, start, warm = (key, bucket), deque([(_NONE, [])]), None, False
        if kind == _OWN and start is None:
            live, start = label_states(live, key, bucket), True
        elif kind == _HALO and not warm:
            # a firing older than the warm-up is still possible here, and counts as none from now on
            warm = True
            if live[0][0] != _NONE:
                live.appendleft((_NONE, []))
        pos, q = (ts, seq), (q_ts, q_seq)
        moved, hit = [], False
        while live and live[0][0] < q:
            moved.extend(live.popleft()[1])
            hit = True
        if hit or kind == _ENTRY:
            live.append((pos, moved))
    if group is not None:
        yield from close(*group, live, start)


def _keyed(batches):
    for (key,), *rest in _grouped(batches, _CAND_COLS[:1], _CAND_COLS[1:]):
        yield (key, *rest)


def _handover(window_us: int, bucket_us: int):
    return lambda batches: _emit(
        handover_rows(_keyed(batches), lambda key: (window_us, bucket_us)), _HANDOVER_ARROW
    )


def chain_rows(rows):
    """Follow the handover maps of one key bucket by bucket; constant state. ``rows`` are ``(key, bucket, in_ts, in_seq,
    out_ts, out_seq)`` in order."""
    key = bucket = None
    state, nxt = _NONE, None
    for k, b, in_ts, in_seq, out_ts, out_seq in rows:
        if (k, b) != (key, bucket):
            if nxt is not None and nxt != _NONE:
                yield (key, bucket + 1, *nxt)
            follows = k == key and b == bucket + 1
            state = nxt if follows and nxt is not None else _NONE
            key, bucket, nxt = k, b, None
        if (in_ts, in_seq) == _ANY or (in_ts, in_seq) == state:
            nxt = (out_ts, out_seq)
    if nxt is not None and nxt != _NONE:
        yield (key, bucket + 1, *nxt)


def _chain():
    names = ("key", "bucket", "in_ts", "in_seq", "out_ts", "out_seq")
    return lambda batches: _emit(chain_rows(_rows(batches, names)), _CHAIN_ARROW)


def _fire():
    """Emit the firings of each bucket, given the firing it received (a ``_RECEIVED`` row); constant state."""

    def fold(rows):
        group, last = None, _NONE
        for key, bucket, kind, ts, seq, q_ts, q_seq in rows:
            if group != (key, bucket):
                group, last = (key, bucket), _NONE
            if kind == _RECEIVED:
                last = (ts, seq)
            elif kind == _OWN and last < (q_ts, q_seq):
                prev = (None, None) if last == _NONE else last
                yield (key, ts, seq, *prev)
                last = (ts, seq)

    return lambda batches: _emit(fold(_keyed(batches)), _FIRE_ARROW)


def firings(candidates: DataFrame, window_us: int, bucket_us: int) -> DataFrame:
    """Rows of ``candidates`` that fire.

    Input columns ``key, ts_us, event_seq, q_ts, q_seq`` (all but ``key`` BIGINT); output ``key, ts_us, event_seq,
    prev_ts, prev_seq``, where ``prev_*`` is the firing before it if it lies in the same or the previous bucket.
    """
    if bucket_us < 2 * window_us:
        raise ValueError("a bucket must be at least two windows wide")
    home = bucket_sql("ts_us", bucket_us)

    def copy(bucket, kind):
        return f"named_struct('bucket', {bucket}, 'kind', {kind})"

    # The candidates of the last two windows warm up the next bucket: the earlier half as possible last firings,
    # the later half only to let those states merge.
    own, following, end = copy(home, _OWN), f"{home} + 1", f"({home} + 1) * {bucket_us}L"
    copies = f"""CASE
      WHEN ts_us + {window_us}L >= {end} THEN array({own}, {copy(following, _HALO)})
      WHEN ts_us + {2 * window_us}L >= {end} THEN array({own}, {copy(following, _ENTRY)})
      ELSE array({own}) END"""
    # Both folds read this one exchange, so that candidates are computed once; the second one skips the copies
    # itself, as a filter would move below the exchange and make it a different one.
    spread = candidates.selectExpr("key", f"inline({copies})", "ts_us", "event_seq", "q_ts", "q_seq").repartition(
        "key", "bucket"
    )
    maps = spread.sortWithinPartitions(*_ORDER).mapInArrow(_handover(window_us, bucket_us), _HANDOVER_DDL)
    received = (
        maps.repartition("key")
        .sortWithinPartitions("key", "bucket", "in_ts", "in_seq")
        .mapInArrow(_chain(), _CHAIN_DDL)
    )
    entries = received.selectExpr(
        "key", "bucket", f"{_RECEIVED} AS kind", "ts_us", "event_seq", "CAST(null AS bigint) AS q_ts", "CAST(null AS bigint) AS q_seq"
    )
    return (
        spread.unionByName(entries)
        .repartition("key", "bucket")
        .sortWithinPartitions(*_ORDER)
        .mapInArrow(_fire(), _FIRE_DDL)
    )
