"""Brute-force rule: T failed logins of one source within W seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.rearm import firings
from sparkwarden.operators.timebuckets import SECOND_US, with_halo


def failed_logins(events: DataFrame) -> DataFrame:
    """Failed logins with a source, the only rows the rule looks at."""
    return events.filter("action = 'FAILED_LOGIN' AND source_ip IS NOT NULL")


def brute_force_candidates(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Failures whose T-th latest failure of the same source is at most W old; ``q_*`` is that failure."""
    window_us = cfg.brute_window_s * SECOND_US
    rows = failed_logins(events).selectExpr("source_ip AS key", "unix_micros(event_ts) AS ts_us", "event_seq")
    back = cfg.brute_threshold - 1
    by_time = "OVER (PARTITION BY key, bucket ORDER BY ts_us, event_seq)"
    return (
        with_halo(rows, window_us, cfg.bucket_factor * window_us)
        .selectExpr(
            "key", "ts_us", "event_seq", "is_halo",
            f"lag(ts_us, {back}) {by_time} AS q_ts",
            f"lag(event_seq, {back}) {by_time} AS q_seq",
        )
        .filter(f"NOT is_halo AND q_ts >= ts_us - {window_us}L")
        .drop("is_halo")
    )


def brute_force_firings(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Failures that fire the rule; each firing empties the window and re-arms it."""
    window_us = cfg.brute_window_s * SECOND_US
    return firings(brute_force_candidates(events, cfg), window_us, cfg.bucket_factor * window_us)
