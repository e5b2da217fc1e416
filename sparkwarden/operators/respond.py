"""What follows an alert: notification payloads, playbook routing, mitigations and the blocklist."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.scalar import severity_rank
from sparkwarden.operators.joins import lookup_join
from sparkwarden.schema import BLOCK_PLAYBOOK, DISABLE_PLAYBOOK, ROUTES_INTENDED, SEVERITY_RANK

MITIGATION_COLUMNS = ("timestamp", "playbook", "action", "target", "reason", "triggering_alert_id", "status")

# Severity -> marker of a payload; other words get the alarm.
_MARKERS = {"low": "ℹ️", "medium": "⚠️", "high": "\U0001f6a8", "critical": "\U0001f525"}


def webhook_payload(alerts: DataFrame, headline: str = "SECURITY ALERT") -> DataFrame:
    """Add ``payload``, the JSON text a chat webhook takes; ``headline`` is its bold title."""
    marks = F.create_map(*[F.lit(x) for p in _MARKERS.items() for x in p])
    mark = F.coalesce(F.try_element_at(marks, F.coalesce("severity", F.lit("low"))), F.lit(_MARKERS["high"]))
    color = F.when(F.col("severity").isin("high", "critical"), "danger").otherwise("warning")

    def field(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    # Titles and default texts of the payload's fields.
    fields = F.array(
        field("Severity", F.upper(F.coalesce("severity", F.lit("unknown"))), True),
        field("Source IP", F.coalesce("source_ip", F.lit("unknown")), True),
        field("Description", F.coalesce("description", F.lit("No description provided")), False),
        field("Evidence Count", F.coalesce("evidence_count", F.lit(0)).cast("string"), True),
    )
    attachment = F.struct(
        F.concat(F.lit("Rule Triggered: "), F.coalesce("rule_name", F.lit("None"))).alias("title"),
        color.alias("color"),
        fields.alias("fields"),
    )
    text = F.concat_ws(" ", mark, F.lit(f"**{headline}**"), mark)
    return alerts.withColumn(
        "payload", F.to_json(F.struct(text.alias("text"), F.array(attachment).alias("attachments")))
    )


def dispatch(alerts: DataFrame, destinations: Iterable[str], min_severity: str = "high") -> DataFrame:
    """One row per alert at or above ``min_severity`` and destination; an unknown minimum means ``high``.

    Destinations are a short configured list, so they are an array on each row, not a join.
    """
    names = list(destinations)
    floor = SEVERITY_RANK.get(min_severity.lower(), 3)
    targets = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return alerts.filter(severity_rank("severity") >= floor).withColumn(
        "destination", F.explode(targets)
    )


def response_gate(alerts: DataFrame) -> DataFrame:
    """Named alerts of severity high or critical, the ones that playbooks see."""
    return alerts.filter(
        F.col("rule_name").isNotNull() & F.lower(F.coalesce("severity", F.lit("low"))).isin("high", "critical")
    )


def routes_table(spark: SparkSession, routes=ROUTES_INTENDED) -> DataFrame:
    return spark.createDataFrame(list(routes), "rule_name string, playbook string")


def route(alerts: DataFrame, routes: DataFrame) -> DataFrame:
    """Alerts with each playbook that answers their rule. A route table is a few rows, and then sent to every task."""
    small = routes.limit(10_001).count() <= 10_000
    return alerts.join(F.broadcast(routes) if small else routes, "rule_name")


def _mitigation(routed: DataFrame, action: str, target: Column, reason: Column) -> DataFrame:
    return routed.select(
        F.col("created_at").alias("timestamp"),
        "playbook",
        F.lit(action).alias("action"),
        target.alias("target"),
        reason.alias("reason"),
        F.col("alert_id").alias("triggering_alert_id"),
        F.lit("applied").alias("status"),
    )


def block_ip(routed: DataFrame) -> DataFrame:
    """BLOCK_IP mitigations of routed alerts that name a source."""
    rows = routed.filter((F.col("playbook") == BLOCK_PLAYBOOK) & F.col("source_ip").isNotNull())
    reason = F.concat(F.lit("Auto-mitigation due to "), "rule_name", F.lit(" alert."))  # fixed text
    return _mitigation(rows, "BLOCK_IP", F.col("source_ip"), reason)


def user_from_metadata() -> Column:
    """The alert's own user."""
    return F.coalesce("metadata.user", F.lit("unknown_actor"))


def user_from_evidence() -> Column:
    """The user as the raw evidence text shows it: only two accounts are looked for, and the last event wins."""

    def look(found, e):
        relevant = e["action"].contains("SUDO_COMMAND") | e["action"].contains("FAIL")
        raw = F.coalesce(e["raw"], F.lit(""))
        hit = F.when(raw.contains("for sysadmin") | raw.contains("sysadmin :"), "sysadmin").when(
            raw.contains("for root") | raw.contains("root :"), "root"
        )
        return F.coalesce(F.when(relevant, hit), found)

    return F.coalesce(F.aggregate("evidence", F.lit(None).cast("string"), look), F.lit("unknown_actor"))


def disable_user(routed: DataFrame, target: Callable[[], Column] = user_from_metadata) -> DataFrame:
    """DISABLE_USER mitigations of routed alerts that carry evidence."""
    rows = routed.filter((F.col("playbook") == DISABLE_PLAYBOOK) & (F.col("evidence_count") > 0))
    reason = F.concat(F.lit("Auto-mitigation due to "), "rule_name", F.lit(" (Compromised Credentials)."))  # fixed text
    return _mitigation(rows, "DISABLE_USER", target(), reason)


@dataclass(frozen=True)
class Playbook:
    """A named answer to alerts: which rules it serves and how routed rows become mitigations."""

    name: str
    rules: tuple[str, ...]
    act: Callable[[DataFrame], DataFrame]


def mitigations(alerts: DataFrame, routes: DataFrame, extra: Iterable[Playbook] = ()) -> DataFrame:
    """Mitigation rows of all playbooks for the alerts that pass the gate."""
    routed = route(response_gate(alerts), routes)
    out = block_ip(routed).unionByName(disable_user(routed))
    for playbook in extra:
        rows = response_gate(alerts).filter(F.col("rule_name").isin(*playbook.rules))
        out = out.unionByName(playbook.act(rows.withColumn("playbook", F.lit(playbook.name))))
    return out.select(*MITIGATION_COLUMNS)


def first_blocks(firings: DataFrame) -> DataFrame:
    """``source_ip, block_ts, block_seq``: the first routed firing of each source. Partial minima come first, so a
    source with many firings shuffles one row per task."""
    return (
        firings.filter(F.col("source_ip").isNotNull())
        .groupBy("source_ip")
        .agg(F.min(F.struct("block_ts", "block_seq")).alias("_b"))
        .select("source_ip", "_b.block_ts", "_b.block_seq")
    )


def drop_blocked(events: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: an event is dropped iff its source was blocked before it in ``(ts, seq)`` order.

    The event that caused the block stays, and so do events without a source. ``blocks`` as in :func:`first_blocks`;
    it is counted to pick the join, so pass a stored table.
    """
    marked = lookup_join(events, blocks, "source_ip")
    after = (F.unix_micros("event_ts") > F.col("block_ts")) | (
        (F.unix_micros("event_ts") == F.col("block_ts")) & (F.col("event_seq") > F.col("block_seq"))
    )
    late = F.coalesce(after, F.lit(False))
    return tuple(marked.filter(c).select(*events.columns) for c in (~late, late))
