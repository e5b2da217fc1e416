"""Queries over the event, alert and mitigation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.schema import (
    ANOMALY_RULE,
    BRUTE_RULE,
    ESCALATION_RULE,
    INTEL_RULE,
    RULE_ORDER,
    RULE_SEVERITY,
    SCAN_RULE,
)


def list_alerts(
    alerts: DataFrame, status: str | None = None, severity: str | None = None, limit: int = 50, skip: int = 0
) -> DataFrame:
    """Newest alerts first, optionally of one status and severity."""
    for name, value in (("status", status), ("severity", severity)):
        if value:
            alerts = alerts.filter(F.col(name) == value)
    return alerts.orderBy(F.desc("created_at"), "alert_id").offset(skip).limit(limit)


def list_events(events: DataFrame, source_ip: str | None = None, limit: int = 100) -> DataFrame:
    """Newest events first, optionally of one source."""
    if source_ip:
        events = events.filter(F.col("source_ip") == source_ip)
    return events.orderBy(F.desc("event_ts"), F.desc("event_seq")).limit(limit)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Alerts per severity, most frequent first."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "severity")


def list_mitigations(mitigations: DataFrame, limit: int = 50) -> DataFrame:
    """Newest mitigations first."""
    return mitigations.orderBy(F.desc("timestamp"), "triggering_alert_id", "action").limit(limit)


def _count(df: DataFrame, name: str, condition=None) -> DataFrame:
    column = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.agg(column.alias(name))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Side by side, frames of exactly one row each (aggregates without keys)."""
    keyed = [f.withColumn("_one", F.lit(1)) for f in frames]
    out = keyed[0]
    for f in keyed[1:]:
        out = out.join(F.broadcast(f), "_one")
    return out.drop("_one")


def ingest_summary(kept: DataFrame, rejects: DataFrame, dropped: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts of one load: ingested, failed, dropped and alerts_triggered."""
    return _one_row(
        _count(kept, "ingested"),
        _count(rejects, "failed"),
        _count(dropped, "dropped"),
        _count(alerts, "alerts_triggered"),
    )


def engine_stats(events: DataFrame, alerts: DataFrame, rules: int) -> DataFrame:
    """Events processed, alerts, the number of rules that made them, and the alert rate as text."""
    counts = _one_row(_count(events, "events_processed"), _count(alerts, "alerts_generated"))
    rate = F.format_string("%.2f%%", F.col("alerts_generated") / F.nullif("events_processed", F.lit(0)) * 100)
    return counts.select(
        "events_processed",
        "alerts_generated",
        F.lit(rules).cast("bigint").alias("rules_loaded"),
        F.when(F.col("events_processed") > 0, rate).otherwise("0%").alias("alert_rate"),
    )


def rule_catalogue(spark: SparkSession, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Name, description and severity of each rule in evaluation order."""
    texts = {
        INTEL_RULE: f"The feed scores this source {cfg.intel_min_score} or higher",
        BRUTE_RULE: f"One source fails to log in {cfg.brute_threshold} times or more in {cfg.brute_window_s} s",
        SCAN_RULE: f"One source reaches {cfg.scan_threshold} different ports or more in {cfg.scan_window_s} s",
        ESCALATION_RULE: f"A user runs sudo at most {cfg.escalation_lookback_s} s after a failed login of the same name",
        ANOMALY_RULE: "An isolation forest over hour, weekend, rate and ports puts this event among the outliers",
    }
    rows = [(i, r, texts[r], RULE_SEVERITY[r]) for i, r in enumerate(RULE_ORDER)]
    return spark.createDataFrame(rows, "rule_order int, name string, description string, severity string")


def dashboard(events: DataFrame, alerts: DataFrame, mitigations: DataFrame) -> DataFrame:
    """The four summary cards: events, alerts, high or critical alerts, mitigations."""
    counted = alerts.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_risk_alerts"),
    )
    return _one_row(_count(events, "events"), counted, _count(mitigations, "mitigations"))


def flatten_evidence(alerts: DataFrame) -> DataFrame:
    """One row per evidence event of each alert: time, source and action."""
    return alerts.select("alert_id", "rule_name", F.explode("evidence").alias("e")).select(
        "alert_id", "rule_name", F.col("e.event_ts").alias("event_ts"), F.col("e.source_ip").alias("source_ip"),
        F.col("e.action").alias("action"), F.col("e.event_seq").alias("event_seq"),
    )


def targeted_users(evidence: DataFrame) -> DataFrame:
    """Distinct users per firing of flat evidence rows; a null user is ``unknown``."""
    return evidence.groupBy("key", "trigger_seq").agg(
        F.array_sort(F.collect_set(F.coalesce("user", F.lit("unknown")))).alias("users")
    )
