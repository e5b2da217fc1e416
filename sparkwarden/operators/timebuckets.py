"""Split a keyed event sequence into (key, time bucket) groups.

A window over one key would put a busy source in one task. Every sliding-window operator here looks back at most
``window_us``, so it partitions by ``(key, bucket)`` and copies the rows that a neighbour still needs ("halo" rows)
into the next bucket. The buckets of one key are then independent tasks, whatever share of the data the key holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SECOND_US = 1_000_000


def bucket_sql(ts: str, bucket_us: int) -> str:
    """SQL text of the floor of ``ts / bucket_us`` in whole numbers (right for times before 1970 too)."""
    return f"(({ts} - pmod({ts}, {bucket_us}L)) div {bucket_us}L)"


def with_halo(df: DataFrame, reach_us: int, bucket_us: int, ts: str = "ts_us") -> DataFrame:
    """Add ``bucket`` and ``is_halo``; rows within ``reach_us`` of their bucket's end also appear in the next one.

    A row at ``s`` serves a later row at ``t`` iff ``s >= t - reach_us``; the next bucket starts at
    ``(bucket + 1) * bucket_us``, so the copy is made iff ``s + reach_us`` gets there.
    """
    if reach_us > bucket_us:
        raise ValueError("a bucket must be at least as wide as the look-back")
    home = bucket_sql(ts, bucket_us)
    own = f"named_struct('bucket', {home}, 'is_halo', false)"
    copy = f"named_struct('bucket', {home} + 1, 'is_halo', true)"
    reaches_next = f"{ts} + {reach_us}L >= ({home} + 1) * {bucket_us}L"
    return df.selectExpr("*", f"inline(if({reaches_next}, array({own}, {copy}), array({own})))")
