"""Escalation rule: sudo by a user who recently failed to log in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.rearm import firings
from sparkwarden.operators.timebuckets import SECOND_US, with_halo


def login_and_sudo(events: DataFrame) -> DataFrame:
    """Failed logins and sudo commands with a user, the only rows the rule looks at."""
    return events.filter("action IN ('FAILED_LOGIN', 'SUDO_COMMAND') AND user IS NOT NULL")


def escalation_candidates(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Sudo rows with at least m failures of the user in the look-back; ``q_*`` is the m-th latest failure and
    ``sudo_*`` the sudo row before it in time."""
    lookback_us = cfg.escalation_lookback_s * SECOND_US
    rows = login_and_sudo(events).selectExpr(
        "user AS key", "unix_micros(event_ts) AS ts_us", "event_seq", "action = 'SUDO_COMMAND' AS is_sudo"
    )
    by_time = "PARTITION BY key, bucket ORDER BY ts_us, event_seq"
    same_kind = "PARTITION BY key, bucket, is_sudo ORDER BY ts_us, event_seq"
    return (
        with_halo(rows, lookback_us, cfg.bucket_factor * lookback_us)
        .repartition("key", "bucket")
        # on a failure row: the m-th latest failure; on a sudo row: the previous sudo
        .selectExpr(
            "*",
            f"lag(struct(ts_us, event_seq), {cfg.escalation_min_failures - 1}) OVER ({same_kind}) AS mth",
            f"lag(struct(ts_us, event_seq), 1) OVER ({same_kind}) AS prev",
        )
        # wrapped, so that a failure without an m-th latest one does not show an older row's value
        .selectExpr(
            "*",
            f"last(if(is_sudo, null, struct(mth)), true) OVER ({by_time} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest",
        )
        .filter(f"is_sudo AND NOT is_halo AND latest.mth.ts_us >= ts_us - {lookback_us}L")
        .selectExpr(
            "key", "ts_us", "event_seq", "latest.mth.ts_us AS q_ts", "latest.mth.event_seq AS q_seq",
            "prev.ts_us AS sudo_ts", "prev.event_seq AS sudo_seq",
        )
    )


def escalation_firings(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Sudo rows that fire; each firing forgets the user's failures.

    With m = 1 no fold is needed: a sudo fires iff a failure in its look-back came after the previous sudo, as that
    one either fired on every earlier failure still in reach, or there was none.
    """
    lookback_us = cfg.escalation_lookback_s * SECOND_US
    candidates = escalation_candidates(events, cfg)
    if cfg.escalation_min_failures > 1:
        return firings(candidates.drop("sudo_ts", "sudo_seq"), lookback_us, cfg.bucket_factor * lookback_us)
    return candidates.filter("sudo_seq IS NULL OR q_ts > sudo_ts OR (q_ts = sudo_ts AND q_seq > sudo_seq)").selectExpr(
        "key", "ts_us", "event_seq", "sudo_ts AS prev_ts", "sudo_seq AS prev_seq"
    )
