"""Scalar column functions; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.schema import ACTION_SEVERITY, SEVERITY_RANK


def map_sql(values: dict) -> str:
    """SQL text of a literal map."""
    return "map(" + ", ".join(f"{k!r}, {v!r}" for k, v in values.items()) + ")"


# Severity of ``{action}``; null-free, unknown actions are ``info``.
ACTION_SEVERITY_SQL = f"coalesce(try_element_at({map_sql(ACTION_SEVERITY)}, {{action}}), 'info')"


def action_severity(action: str, default: str = "null") -> Column:
    """Severity of the action in column ``action``; unknown actions get the column ``default``, else ``info``."""
    return F.expr(f"coalesce(try_element_at({map_sql(ACTION_SEVERITY)}, {action}), {default}, 'info')")


def severity_rank(severity: str, default: int = 1) -> Column:
    """Rank of the severity word in column ``severity``, in any case; unknown or null words get ``default``."""
    return F.expr(f"coalesce(try_element_at({map_sql(SEVERITY_RANK)}, lower({severity})), {default})")


# The month-first clock time of a syslog header, and the ISO forms read from JSON.
_SYSLOG_CLOCK = "yyyy MMM d HH:mm:ss"
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
_ISO_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"


def syslog_ts(clock: Column, year: Column | int) -> Column:
    """UTC instant of a year-less header time in ``year``; impossible dates give null.

    The zone is written into the parsed text, so the session zone does not matter.
    """
    year = F.lit(year) if isinstance(year, int) else year
    text = F.concat_ws(" ", year.cast("string"), F.initcap(F.regexp_replace(clock, r"\s+", " ")), F.lit("+0000"))
    return F.try_to_timestamp(text, F.lit(_SYSLOG_CLOCK + " xx"))


def iso_ts(text: Column) -> Column:
    """Instant of an ISO-8601 text; a time without offset is UTC; anything else gives null."""
    dated = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(
        F.replace(text, F.lit(","), F.lit("."))
    )
    zoned = F.when(dated.rlike(r"T.*" + _ISO_OFFSET) | dated.rlike(r" .*" + _ISO_OFFSET), dated).otherwise(
        F.concat(dated, F.lit("Z"))
    )
    return F.when(text.rlike(_ISO), zoned.try_cast("timestamp"))


def iso_wall(text: Column) -> Column:
    """Clock time as written, without its offset."""
    clock = F.when(F.length(text) > 10, F.regexp_replace(text, _ISO_OFFSET, "")).otherwise(text)
    return F.when(text.rlike(_ISO), F.replace(clock, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))


def utc_wall(ts: Column) -> Column:
    """Clock time of an instant in UTC, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)


# Hour, weekend, failed-login and sudo indicators of one event with ``event_wall`` and ``action``.
STATIC_FEATURES = (
    "coalesce(hour(event_wall), 0) AS hour_of_day",
    "coalesce(int(weekday(event_wall) >= 5), 0) AS is_weekend",
    "coalesce(int(action = 'FAILED_LOGIN'), 0) AS is_failed_login",
    "coalesce(int(action = 'SUDO_COMMAND'), 0) AS is_sudo",
)
