"""Column types and fixed vocabularies of the event, alert and mitigation tables."""

from __future__ import annotations

# Action -> severity of the normalized event.
ACTION_SEVERITY = {
    "FAILED_LOGIN": "medium",
    "ACCEPTED_LOGIN": "info",
    "SUDO_COMMAND": "high",
    "CONNECTION": "low",
    "BLOCKED": "medium",
    "OTHER": "info",
}

# Severity -> rank used by the dispatch gate.
SEVERITY_RANK = {"info": 1, "low": 1, "medium": 2, "high": 3, "critical": 4}

# Alert life cycle.
ALERT_STATUSES = ("new", "investigating", "resolved", "false_positive")

# Rule names in evaluation order, with their severities.
INTEL_RULE = "threat_intel_match"
BRUTE_RULE = "brute_force_ssh"
SCAN_RULE = "port_scan"
ESCALATION_RULE = "privilege_escalation"
ANOMALY_RULE = "ml_behavioral_anomaly"
RULE_ORDER = (INTEL_RULE, BRUTE_RULE, SCAN_RULE, ESCALATION_RULE, ANOMALY_RULE)
RULE_SEVERITY = {
    INTEL_RULE: "critical",
    BRUTE_RULE: "high",
    SCAN_RULE: "high",
    ESCALATION_RULE: "critical",
    ANOMALY_RULE: "high",
}

# Playbook names, and which rule each one answers. ROUTES_AS_CODED keeps two rule names that no rule
# carries, so only anomaly alerts block; ROUTES_INTENDED is what the documentation expects.
BLOCK_PLAYBOOK = "block_malicious_ip"
DISABLE_PLAYBOOK = "disable_compromised_user"
ROUTES_AS_CODED = (
    ("ssh_brute_force", BLOCK_PLAYBOOK),
    ("horizontal_port_scan", BLOCK_PLAYBOOK),
    (ANOMALY_RULE, BLOCK_PLAYBOOK),
    (ESCALATION_RULE, DISABLE_PLAYBOOK),
)
ROUTES_INTENDED = (
    (INTEL_RULE, BLOCK_PLAYBOOK),
    (BRUTE_RULE, BLOCK_PLAYBOOK),
    (SCAN_RULE, BLOCK_PLAYBOOK),
    (ANOMALY_RULE, BLOCK_PLAYBOOK),
    (ESCALATION_RULE, DISABLE_PLAYBOOK),
)

INTEL_TYPE = "struct<reputation_score:int,tags:array<string>,provider:string,malicious:boolean>"

# The normalized event table.
EVENT_COLUMNS = {
    "event_seq": "bigint",
    "event_ts": "timestamp",
    "event_wall": "timestamp_ntz",
    "ts_inferred": "boolean",
    "source_ip": "string",
    "hostname": "string",
    "service": "string",
    "action": "string",
    "user": "string",
    "destination_port": "bigint",
    "severity": "string",
    "raw": "string",
    "message": "string",
    "pid": "string",
    "metadata": "map<string,string>",
    "ingested_at": "timestamp",
}

EVIDENCE_TYPE = (
    "array<struct<event_seq:bigint,event_ts:timestamp,source_ip:string,user:string,action:string,"
    "destination_port:bigint,raw:string>>"
)

FEATURES_TYPE = (
    "struct<hour_of_day:int,is_weekend:int,is_failed_login:int,is_sudo:int,velocity_60s:bigint,"
    "unique_ports_60s:bigint>"
)

# One struct holds every rule's metadata; the fields of other rules stay null.
ALERT_METADATA = {
    "attempt_count": "bigint",
    "targeted_users": "array<string>",
    "unique_port_count": "bigint",
    "ports_scanned": "array<bigint>",
    "window_seconds": "int",
    "user": "string",
    "failed_auth_count": "bigint",
    "sudo_command": "string",
    "lookback_seconds": "int",
    "model": "string",
    "features": FEATURES_TYPE,
}

ALERT_COLUMNS = (
    "alert_id",
    "rule_name",
    "rule_order",
    "severity",
    "source_ip",
    "user",
    "description",
    "context",
    "evidence",
    "evidence_count",
    "metadata",
    "status",
    "created_at",
    "updated_at",
    "trigger_seq",
)

# Feature vector order.
FEATURE_NAMES = (
    "hour_of_day",
    "is_weekend",
    "is_failed_login",
    "is_sudo",
    "velocity_60s",
    "unique_ports_60s",
)
