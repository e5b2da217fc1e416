"""Behaviour features of events: clock features, event velocity and distinct ports per source."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.functions.scalar import STATIC_FEATURES
from sparkwarden.operators.timebuckets import SECOND_US, bucket_sql


def window_features(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ()) -> DataFrame:
    """``event_seq, velocity, distinct_ports`` (and the columns ``keep``) over ``(t - W, t]`` of the same source.

    Same-time events count for each other; a null source counts nothing; null and -1 ports are no ports.

    Sweep instead of a sliding frame, so cost does not grow with the number of events in a window: an event is live in
    ``[t, t + W)`` and its port until the next use of that port or ``t + W``. Each event adds signed steps at
    those times, clipped to its ``(source, bucket)`` group; a running sum over time gives both features. One shuffle.
    """
    window_us = cfg.feature_window_s * SECOND_US
    bucket_us = cfg.bucket_factor * window_us
    home, expiry = bucket_sql("ts", bucket_us), f"(ts + {window_us}L)"
    start, end = f"(bucket * {bucket_us}L)", f"((bucket + 1) * {bucket_us}L)"
    payload = ", ".join(("event_seq", *keep))

    located = events.filter("source_ip IS NOT NULL").selectExpr(
        "source_ip",
        "unix_micros(event_ts) AS ts",
        "if(destination_port = -1, null, destination_port) AS port",
        f"struct({payload}) AS event",
    )
    own = f"named_struct('bucket', {home}, 'event', event)"
    copy = f"named_struct('bucket', {home} + 1, 'event', if(false, event, null))"
    in_next = f"{expiry} > ({home} + 1) * {bucket_us}L"
    clipped = located.selectExpr(
        "source_ip", "ts", "port", f"inline(if({in_next}, array({own}, {copy}), array({own})))"
    ).repartition("source_ip", "bucket")
    # how long the row keeps its port in use, clipped to the bucket; an empty span counts nothing
    spans = clipped.selectExpr(
        "*", "lead(ts) OVER (PARTITION BY source_ip, bucket, port ORDER BY ts) AS next_use"
    ).selectExpr(
        "source_ip", "bucket", "event", "ts", f"greatest(ts, {start}) AS opened",
        f"if(port IS NULL, null, least({expiry}, coalesce(next_use, {expiry}))) AS closed",
    )

    def step(at, velocity, ports, event="if(false, event, null)"):
        return f"named_struct('at', {at}, 'dv', {velocity}, 'dp', {ports}, 'event', {event})"

    holds_port = "coalesce(closed > opened, false)"
    steps = f"""array_compact(array(
        {step("opened", 1, f"int({holds_port})", "event")},
        if({expiry} < {end}, {step(expiry, -1, 0)}, null),
        if({holds_port} AND closed < {end}, {step("closed", 0, -1)}, null)))"""
    by_time = "OVER (PARTITION BY source_ip, bucket ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    swept = (
        spans.selectExpr("source_ip", "bucket", f"inline({steps})")
        .selectExpr("event", f"sum(dv) {by_time} AS velocity", f"sum(dp) {by_time} AS distinct_ports")
        .filter("event IS NOT NULL")
        .selectExpr("event.*", "velocity", "distinct_ports")
    )
    unlocated = events.filter("source_ip IS NULL").selectExpr(
        "event_seq", *keep, "0L AS velocity", "0L AS distinct_ports"
    )
    return swept.unionByName(unlocated)


def feature_matrix(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ()) -> DataFrame:
    """``event_seq``, the columns ``keep`` and the six features in their fixed order; nothing is null."""
    needed = tuple(dict.fromkeys(("event_wall", "action", *keep)))
    windowed = window_features(events, cfg, needed)
    return windowed.selectExpr(
        "event_seq", *keep, *STATIC_FEATURES, "velocity AS velocity_60s", "distinct_ports AS unique_ports_60s"
    )
