"""Alert rows of every rule in one schema. The description and context texts are fixed values, stated where they are
filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators import brute_force as bf
from sparkwarden.operators import port_scan as ps
from sparkwarden.operators import priv_escalation as pe
from sparkwarden.operators.evidence import EVIDENCE_FIELDS, attach_evidence
from sparkwarden.operators.timebuckets import SECOND_US
from sparkwarden.schema import (
    ALERT_METADATA,
    BRUTE_RULE,
    ESCALATION_RULE,
    EVIDENCE_TYPE,
    INTEL_RULE,
    RULE_ORDER,
    RULE_SEVERITY,
    SCAN_RULE,
)


def alert_rows(df: DataFrame, forms: dict[str, tuple[dict[str, str], dict[str, str]]]) -> DataFrame:
    """Alert rows of several rules in one pass. ``df`` has ``rule_name, key, trigger_seq, trigger_ts, evidence,
    evidence_count``; ``forms`` gives by rule SQL texts of ``source_ip, user, description, context`` (null if absent) and
    those of the rule's details.

    The id is a hash of rule, key, trigger time and triggering event, so a rerun gives the same ids, and events of another
    load that carry the same number give others; times are event time.
    """

    def by_rule(value):
        return "CASE rule_name " + " ".join(f"WHEN '{rule}' THEN {value(rule)}" for rule in forms) + " END"

    def text(part, name, kind):
        if not any(name in form[part] for form in forms.values()):
            return f"CAST(null AS {kind})"
        return by_rule(lambda rule: f"CAST({forms[rule][part].get(name, 'null')} AS {kind})")

    details = ", ".join(f"'{name}', {text(1, name, kind)}" for name, kind in ALERT_METADATA.items())
    return df.selectExpr(
        "sha2(concat_ws('|', rule_name, key, trigger_ts, trigger_seq), 256) AS alert_id",
        "rule_name",
        f"{by_rule(RULE_ORDER.index)} AS rule_order",
        f"{by_rule(lambda rule: repr(RULE_SEVERITY[rule]))} AS severity",
        *[f"{text(0, n, 'string')} AS {n}" for n in ("source_ip", "user", "description", "context")],
        f"CAST(evidence AS {EVIDENCE_TYPE}) AS evidence",
        "CAST(evidence_count AS bigint) AS evidence_count",
        f"named_struct({details}) AS metadata",
        "'new' AS status",
        "timestamp_micros(trigger_ts) AS created_at",
        "timestamp_micros(trigger_ts) AS updated_at",
        "trigger_seq",
    )


def make_alerts(df: DataFrame, rule: str, fields: dict[str, str], metadata: dict[str, str]) -> DataFrame:
    """Alert rows of one ``rule``, as :func:`alert_rows` gives them."""
    return alert_rows(df.withColumn("rule_name", F.lit(rule)), {rule: (fields, metadata)})


def single_event(events: DataFrame) -> DataFrame:
    """Events as firings that are their own evidence."""
    return events.selectExpr(
        "*",
        "coalesce(source_ip, '') AS key",
        "unix_micros(event_ts) AS trigger_ts",
        "event_seq AS trigger_seq",
        f"array(struct({', '.join(EVIDENCE_FIELDS)})) AS evidence",
        "1L AS evidence_count",
    )


def brute_force_alerts(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    window_us = cfg.brute_window_s * SECOND_US
    fired = attach_evidence(
        bf.brute_force_firings(events, cfg),
        bf.failed_logins(events),
        "source_ip",
        window_us,
        cfg.bucket_factor * window_us,
        cfg.evidence_cap,
        cfg.stored_firings,
    )
    return make_alerts(fired, BRUTE_RULE, *brute_force_form(cfg))


def brute_force_form(cfg: DetectConfig) -> tuple[dict[str, str], dict[str, str]]:
    """Fields and details of a brute-force alert."""
    text = (
        "format_string('Brute force attack detected: %d failed login attempts from %s within %d seconds. "
        f"Targeted user(s): %s', evidence_count, key, {cfg.brute_window_s}, array_join(users, ', '))"
    )
    details = {
        "attempt_count": "evidence_count",
        "window_seconds": str(cfg.brute_window_s),
        "targeted_users": "users",
    }
    return {"source_ip": "key", "description": text}, details


def port_scan_alerts(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    window_us = cfg.scan_window_s * SECOND_US
    fired = attach_evidence(
        ps.port_scan_firings(events, cfg),
        ps.port_events(events, cfg),
        "source_ip",
        window_us,
        cfg.bucket_factor * window_us,
        cfg.evidence_cap,
        cfg.stored_firings,
    )
    return make_alerts(fired, SCAN_RULE, *port_scan_form(cfg))


def port_scan_form(cfg: DetectConfig) -> tuple[dict[str, str], dict[str, str]]:
    """Fields and details of a port-scan alert."""
    text = (
        "format_string('Port scan detected: %s connected to %d unique ports within %d seconds. Ports: [%s]', "
        f"key, size(ports), {cfg.scan_window_s}, array_join(CAST(ports AS array<string>), ', '))"
    )
    details = {
        "unique_port_count": "size(ports)",
        "ports_scanned": "ports",
        "window_seconds": str(cfg.scan_window_s),
    }
    return {"source_ip": "key", "description": text}, details


def escalation_alerts(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Evidence is the user's failures in the look-back and the sudo itself; the sudo supplies source and command."""
    lookback_us = cfg.escalation_lookback_s * SECOND_US
    # message rides along with raw as far as this function
    rows = pe.login_and_sudo(events).withColumn("raw", F.struct("raw", "message"))
    fired = attach_evidence(
        pe.escalation_firings(events, cfg), rows, "user", lookback_us, cfg.bucket_factor * lookback_us, None, cfg.stored_firings
    )
    plain = ", ".join(f"{'e.raw.raw' if f == 'raw' else 'e.' + f} AS {f}" for f in EVIDENCE_FIELDS)
    fired = (
        # sudo rows that did not fire are no evidence
        fired.withColumn("evidence", F.expr("filter(evidence, e -> e.action = 'FAILED_LOGIN' OR e.event_seq = trigger_seq)"))
        .selectExpr(
            "key", "trigger_ts", "trigger_seq", "size(evidence) AS evidence_count",
            f"transform(evidence, e -> struct({plain})) AS evidence",
            "coalesce(element_at(evidence, -1).raw.message, 'unknown') AS command",
            "coalesce(element_at(evidence, -1).source_ip, 'local') AS source",
        )
    )
    if cfg.evidence_cap is not None:
        cap = cfg.evidence_cap
        fired = fired.withColumn(
            "evidence", F.expr(f"slice(evidence, greatest(size(evidence) - {cap} + 1, 1), {cap})")
        )
    return make_alerts(fired, ESCALATION_RULE, *escalation_form(cfg))


def escalation_form(cfg: DetectConfig) -> tuple[dict[str, str], dict[str, str]]:
    """Fields and details of an escalation alert; needs ``command`` and ``source`` of the sudo row."""
    text = (
        "format_string('Potential privilege escalation: User \\'%s\\' executed sudo command after %d failed "
        "authentication attempt(s) within %ds. Command: %s', "
        f"key, evidence_count - 1, {cfg.escalation_lookback_s}, command)"
    )
    details = {
        "user": "key",
        "failed_auth_count": "evidence_count - 1",
        "sudo_command": "command",
        "lookback_seconds": str(cfg.escalation_lookback_s),
    }
    return {"source_ip": "source", "user": "key", "description": text}, details


def intel_hits(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Enriched events whose reputation score reaches the minimum."""
    return events.filter(f"intel.reputation_score >= {cfg.intel_min_score}")


def intel_alerts(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """One alert per enriched event of a bad source; no shuffle."""
    context = (
        "format_string('IP found in Threat Intelligence Platform. Reputation Score: %d. Tags: [%s]', "
        "intel.reputation_score, array_join(intel.tags, ', '))"
    )
    return make_alerts(
        single_event(intel_hits(events, cfg)), INTEL_RULE, {"source_ip": "source_ip", "context": context}, {}
    )
