"""Evidence of windowed alerts: which events stood in the window when it fired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.joins import BROADCAST_ROWS
from sparkwarden.operators.timebuckets import bucket_sql
from sparkwarden.plans.materialize import materialize

EVIDENCE_FIELDS = ("event_seq", "event_ts", "source_ip", "user", "action", "destination_port", "raw")


def evidence_rows(
    firings: DataFrame, events: DataFrame, key: str, window_us: int, bucket_us: int, stored: bool = False
) -> DataFrame:
    """One row per event of a firing's window: the event's evidence fields and ``key, trigger_ts, trigger_seq``.

    Windows of one key do not overlap, as a firing empties the window. So each event belongs to the first firing at
    or after it, if that one reaches back far enough: a running "next firing" over ``(key, bucket)``, linear in
    the number of events, where a join on the key would meet every pair. ``events`` holds the rule's own rows only.

    ``stored`` writes the firings to the shared folder first. Their buckets are then counted and, if few enough to send to
    every task, only events of those buckets are shuffled, with their raw text; otherwise all are.
    """
    if stored:
        firings = materialize(firings)
    home = bucket_sql("ts_us", bucket_us)
    # a firing whose window began in the bucket before is needed there too
    into_prev = f"ts_us - {window_us}L < {home} * {bucket_us}L"
    marks = firings.selectExpr(
        "key",
        f"explode(if({into_prev}, array({home}, {home} - 1), array({home}))) AS bucket",
        "ts_us",
        "event_seq AS seq",
        "1 AS kind",
        "struct(ts_us, event_seq) AS fire",
    )
    rows = events.selectExpr(
        f"{key} AS key", "unix_micros(event_ts) AS ts_us", "event_seq AS seq", f"struct({', '.join(EVIDENCE_FIELDS)}) AS event"
    ).selectExpr("key", f"{home} AS bucket", "ts_us", "seq", "0 AS kind", "event")
    if stored:
        buckets = marks.select("key", "bucket").distinct()
        if buckets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(buckets), ["key", "bucket"], "left_semi")
    return (
        rows.unionByName(marks, allowMissingColumns=True)
        .selectExpr(
            "*",
            "last(fire, true) OVER (PARTITION BY key, bucket ORDER BY ts_us DESC, seq DESC, kind DESC "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS next",
        )
        .filter(f"kind = 0 AND ts_us >= next.ts_us - {window_us}L")
        .selectExpr("key", "next.ts_us AS trigger_ts", "next.event_seq AS trigger_seq", "event.*")
    )


def attach_evidence(
    firings: DataFrame,
    events: DataFrame,
    key: str,
    window_us: int,
    bucket_us: int,
    cap: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per firing: ``key, trigger_ts, trigger_seq, evidence, evidence_count``, plus the distinct
    ``users`` and ``ports`` of the evidence.

    The array holds the events of one window in time order, all of them by default. ``cap`` shortens the array to the
    latest events for display, 0 leaves it empty; count, users and ports stay whole, and :func:`evidence_rows` is
    the whole flat form, which has no group to collect. Of two cuts by row number the first is per salt, so a window
    with very many events is not sorted in one task.
    """
    flat = evidence_rows(firings, events, key, window_us, bucket_us, stored)
    group = ("key", "trigger_ts", "trigger_seq")
    # time first, so that sorting the structs sorts by time
    ordered = ", ".join(("event_ts", "event_seq", *(f for f in EVIDENCE_FIELDS if f not in ("event_ts", "event_seq"))))
    fields = ", ".join(f"e.{f} AS {f}" for f in EVIDENCE_FIELDS)
    array = F.expr(f"transform(array_sort(collect_list(struct({ordered}))), e -> struct({fields})) AS evidence")
    whole = (
        F.expr("count(*) AS evidence_count"),
        F.expr("array_sort(collect_set(coalesce(user, 'unknown'))) AS users"),
        F.expr("array_sort(collect_set(destination_port)) AS ports"),
    )
    if cap is None:
        return flat.groupBy(*group).agg(array, *whole)
    counts = flat.groupBy(*group).agg(*whole)
    latest = "ORDER BY event_ts DESC, event_seq DESC"
    shown = (
        flat.selectExpr("*", "pmod(xxhash64(event_seq), 32) AS salt")
        .selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(group)}, salt {latest}) AS nth_of_salt")
        .filter(f"nth_of_salt <= {cap}")
        .selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(group)} {latest}) AS nth")
        .filter(f"nth <= {cap}")
        .groupBy(*group)
        .agg(array)
    )
    return counts.join(shown, list(group), "left").selectExpr(
        *group, "coalesce(evidence, array()) AS evidence", "evidence_count", "users", "ports"
    )
