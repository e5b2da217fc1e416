"""Named queries over the driver tables, each with its SQL form where there is one.

Windows are wide, as the driver's events are sparse (about two a day per user).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.config import DetectConfig
from sparkwarden.functions.scalar import STATIC_FEATURES, action_severity, severity_rank
from sparkwarden.operators import alerts as rules
from sparkwarden.operators import brute_force as bf
from sparkwarden.operators import normalize as nz
from sparkwarden.operators import port_scan as ps
from sparkwarden.operators import priv_escalation as pe
from sparkwarden.operators import reads, respond
from sparkwarden.operators.anomaly import anomaly_alerts
from sparkwarden.operators.enrich import enrich
from sparkwarden.operators.evidence import evidence_rows
from sparkwarden.operators.features import feature_matrix, window_features
from sparkwarden.operators.iforest import fit_iforest, fit_model, predict, score, score_threshold, training_set
from sparkwarden.operators.timebuckets import SECOND_US
from sparkwarden.plans import sql
from sparkwarden.plans.materialize import materialize, shared_dir
from sparkwarden.plans.batch import block_points, detect, rule_set, run_batch, run_rules
from sparkwarden.schema import ROUTES_AS_CODED
from sparkwarden.sources import readers, tables
from sparkwarden.sources.adapter import document_lines, sec_events, sec_intel, sec_lines

HOUR = 3600
CFG = DetectConfig(
    brute_threshold=3,
    brute_window_s=48 * HOUR,
    scan_threshold=8,
    scan_window_s=72 * HOUR,
    escalation_lookback_s=6 * HOUR,
    feature_window_s=48 * HOUR,
    bucket_factor=2,
)
YEAR = 2024
BRUTE_US = CFG.brute_window_s * SECOND_US
SCAN_US = CFG.scan_window_s * SECOND_US
ESC_US = CFG.escalation_lookback_s * SECOND_US
FEAT_US = CFG.feature_window_s * SECOND_US

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared folder."""
    return f"{shared_dir(spark)}/sparkwarden/{name}-{uuid.uuid4().hex}"


def us(column: str = "event_ts", name: str = "ts_us"):
    return F.unix_micros(column).alias(name)


def enriched(spark, sf):
    return enrich(sec_events(spark, sf), sec_intel(spark, sf))


def joined(column, name):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(name)


_BRUTE = sql.brute_ctes("ev", CFG.brute_threshold, BRUTE_US)
_SCAN = sql.scan_ctes("ev", CFG.scan_threshold, SCAN_US)
_ESC = sql.escalation_ctes("ev", CFG.escalation_min_failures, ESC_US)
_BLOCKS = sql.blocks_ctes(CFG.brute_threshold, BRUTE_US, CFG.scan_threshold, SCAN_US, CFG.intel_min_score)
_ALERTS = (_BRUTE, _SCAN, _ESC, sql.alerts_cte("alerts", "ev", CFG))
_KEPT_ALERTS = (
    _BLOCKS,
    sql.brute_ctes("kept", CFG.brute_threshold, BRUTE_US),
    sql.scan_ctes("kept", CFG.scan_threshold, SCAN_US),
    sql.escalation_ctes("kept", CFG.escalation_min_failures, ESC_US),
    sql.alerts_cte("alerts", "kept", CFG),
)

# ---------------------------------------------------------------- sources and sinks

_EVENT_SQL = """
SELECT event_seq, ts_us // 1000000 * 1000000 AS ts_us, source_ip, hostname, service, pid, action, usr AS "user", port AS destination_port,
  severity, CASE WHEN action = 'SUDO_COMMAND' THEN '/bin/run' || k ELSE body END AS message
FROM ev JOIN body USING (event_seq)
"""


def event_view(events):
    return events.select(
        "event_seq", us(), "source_ip", "hostname", "service", "pid", "action", "user", "destination_port", "severity", "message"
    )


_CONTENT_SQL = """
SELECT hostname, service, action, source_ip, usr AS "user", port AS destination_port, severity,
  ts_us // 1000000 * 1000000 AS ts_us, CAST(count(*) AS BIGINT) AS n
FROM ev GROUP BY ALL
"""


def content_counts(events):
    """Event content without arrival numbers, which a file source assigns anew."""
    return events.groupBy(
        "hostname", "service", "action", "source_ip", "user", "destination_port", "severity", us().alias("ts_us")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("s01_read_log_lines", sql.with_ctes(_CONTENT_SQL))
def s01(spark, sf):
    """Lines written as text files, read back and normalized."""
    path = new_path(spark, "lines")
    sec_events(spark, sf).select("raw").write.text(path)
    events, _ = readers.normalize_lines(readers.read_log_lines(spark, path), YEAR)
    return content_counts(events)


def json_docs(events):
    """Events as submitted JSON: even ones structured with an ISO time, odd ones as a raw line."""
    structured = F.to_json(
        F.struct(
            F.date_format("event_wall", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            "source_ip",
            "hostname",
            "service",
            F.lower("action").alias("action"),
            "user",
            F.col("destination_port").cast("string").alias("destination_port"),
            F.lit("critical").alias("severity"),
            F.create_map(F.lit("pid"), F.col("pid")).alias("metadata"),
        )
    )
    raw = F.to_json(F.struct("raw"))
    return F.when(F.col("event_seq") % 2 == 0, structured).otherwise(raw)


@query("s02_read_json_events", sql.with_ctes(_CONTENT_SQL))
def s02(spark, sf):
    """Structured and raw-line JSON documents written as text files, read back and normalized."""
    path = new_path(spark, "json")
    sec_events(spark, sf).select(json_docs(None).alias("value")).write.text(path)
    events, _ = readers.read_json_events(spark, path, YEAR)
    return content_counts(events)


def bulk_envelopes(spark, sf):
    """One bulk envelope per user and day of the feed: failed logins and sudo as lines, the rest as documents."""
    ev = sec_events(spark, sf)
    as_line = F.col("action").isin("FAILED_LOGIN", "SUDO_COMMAND")
    doc = F.to_json(
        F.struct(
            F.date_format("event_wall", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            "source_ip", "hostname", "service", "action", "user", "destination_port",
        )
    )
    parts = ev.select(
        F.coalesce("user", "source_ip").alias("sender"), F.col("event_wall").cast("date").alias("day"), "event_seq",
        F.when(as_line, F.col("raw")).alias("line"), F.when(~as_line, doc).alias("doc"),
    )
    return (
        parts.groupBy("sender", "day")
        .agg(
            F.min("event_seq").alias("batch_seq"),
            F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("event_seq", "line")))).alias("l"),
            F.array_sort(F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("event_seq", "doc")))).alias("d"),
        )
        .select(
            "batch_seq",
            F.concat(
                F.lit('{"logs": '), F.to_json(F.col("l.line")), F.lit(', "events": ['), F.array_join("d.doc", ","), F.lit("]}")
            ).alias("value"),
            F.timestamp_seconds(F.lit(0)).alias("ingested_at"),
        )
    )


@query("s03_explode_bulk", sql.with_ctes(_CONTENT_SQL))
def s03(spark, sf):
    """Bulk envelopes taken apart again: every event is there once."""
    events, _ = readers.normalize_bulk(bulk_envelopes(spark, sf), YEAR)
    return content_counts(events)


@query(
    "s04_write_events",
    sql.with_ctes(
        """SELECT CAST(CAST(wall AS DATE) AS VARCHAR) AS event_date, action, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT source_ip) AS BIGINT) AS sources FROM ev GROUP BY ALL"""
    ),
)
def s04(spark, sf):
    """Event store by day: two appends of half the actions each, read back per day and action."""
    path = new_path(spark, "events")
    ev = sec_events(spark, sf)
    failed = F.col("action") == "FAILED_LOGIN"
    tables.write_events(ev.filter(failed), path)
    tables.write_events(ev.filter(~failed), path)
    stored = tables.read_events(spark, path)
    return stored.groupBy(F.col("event_date").cast("string").alias("event_date"), "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_ip").alias("sources")
    )


@query(
    "s05_write_alerts",
    sql.with_ctes(
        "SELECT severity, rule_name, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY ALL", *_ALERTS
    ),
)
def s05(spark, sf):
    """Alert store: the brute-force alerts are appended first, then all alerts; none is stored twice."""
    path = new_path(spark, "alerts")
    events = enriched(spark, sf)
    tables.write_alerts(rules.brute_force_alerts(events, CFG), path)
    tables.write_alerts(detect(events, CFG), path)
    return spark.read.parquet(path).groupBy("severity", "rule_name").agg(F.count(F.lit(1)).alias("n"))


_MITIGATION_SQL = """
SELECT created_us AS ts_us, CASE WHEN rule_name = 'privilege_escalation' THEN 'disable_compromised_user'
    ELSE 'block_malicious_ip' END AS playbook,
  CASE WHEN rule_name = 'privilege_escalation' THEN 'DISABLE_USER' ELSE 'BLOCK_IP' END AS action,
  key AS target,
  'Auto-mitigation due to ' || rule_name || CASE WHEN rule_name = 'privilege_escalation'
    THEN ' (Compromised Credentials).' ELSE ' alert.' END AS reason,
  sha256(rule_name || '|' || key || '|' || CAST(created_us AS BIGINT) || '|' || trigger_seq) AS triggering_alert_id, 'applied' AS status
FROM alerts
"""


def mitigation_view(m):
    return m.select(us("timestamp"), "playbook", "action", "target", "reason", "triggering_alert_id", "status")


@query("s06_write_mitigations", sql.with_ctes(_MITIGATION_SQL, *_ALERTS))
def s06(spark, sf):
    """Mitigation store: appended twice, stored once."""
    path = new_path(spark, "mitigations")
    found = materialize(detect(enriched(spark, sf), CFG))
    m = respond.mitigations(found, respond.routes_table(spark))
    tables.write_mitigations(m, path)
    tables.write_mitigations(m, path)
    return mitigation_view(spark.read.parquet(path))


@query(
    "s08_write_outbox",
    sql.with_ctes(
        """SELECT destination, rule_name, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT trigger_seq) AS BIGINT) AS triggers
FROM alerts, (VALUES ('chat'), ('pager')) d(destination) GROUP BY ALL""",
        *_ALERTS,
    ),
)
def s08(spark, sf):
    """Notification outbox of two destinations, appended twice, joined back to its alerts."""
    path = new_path(spark, "outbox")
    found = materialize(detect(enriched(spark, sf), CFG))
    for _ in range(2):
        tables.write_outbox(found, path, ["chat", "pager"])
    rows = spark.read.parquet(path).join(found.select("alert_id", "rule_name", "trigger_seq"), "alert_id")
    return rows.groupBy("destination", "rule_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("trigger_seq").alias("triggers")
    )


@query(
    "s09_sorted_layout",
    sql.with_ctes(
        """SELECT action, CAST(count(*) AS BIGINT) AS n, CAST(min(ts_us) AS BIGINT) AS first_us, CAST(max(ts_us) AS BIGINT) AS last_us
FROM ev WHERE source_ip = '10.0.0.7' AND wall >= DATE '2024-01-10' AND wall < DATE '2024-01-20' GROUP BY action"""
    ),
)
def s09(spark, sf):
    """Source and date lookup on the sorted event store: the date prunes folders, the source prunes row groups."""
    path = new_path(spark, "layout")
    tables.write_events(sec_events(spark, sf), path, files_per_day=2)
    hits = tables.read_events(spark, path).filter(
        (F.col("event_date") >= F.lit("2024-01-10").cast("date"))
        & (F.col("event_date") < F.lit("2024-01-20").cast("date"))
        & (F.col("source_ip") == "10.0.0.7")
    )
    return hits.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("event_ts")).alias("first_us"), F.max(F.unix_micros("event_ts")).alias("last_us")
    )


# ---------------------------------------------------------------- parsing and scalar functions


@query(
    "o01_parse_header",
    sql.with_ctes("SELECT event_seq, clock, hostname, service, pid, body AS message FROM ev JOIN body USING (event_seq)"),
)
def o01(spark, sf):
    return nz.parse_header(sec_lines(spark, sf)).select("event_seq", "clock", "hostname", "service", "pid", "message")


@query(
    "o02_classify",
    sql.with_ctes("SELECT action, CAST(count(*) AS BIGINT) AS n, CAST(count(port) AS BIGINT) AS with_port, CAST(count(DISTINCT usr) AS BIGINT) AS users FROM ev GROUP BY action"),
)
def o02(spark, sf):
    parsed, _ = nz.parse_syslog(sec_lines(spark, sf))
    return parsed.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count("destination_port").alias("with_port"), F.count_distinct("user").alias("users")
    )


def _extract(name, action):
    oracle = f"""SELECT event_seq, usr AS "user", source_ip, port AS destination_port,
  CASE WHEN action = 'SUDO_COMMAND' THEN '/bin/run' || k ELSE body END AS message
FROM ev JOIN body USING (event_seq) WHERE action = '{action}'"""

    @query(name, sql.with_ctes(oracle))
    def run(spark, sf):
        parsed, _ = nz.parse_syslog(sec_lines(spark, sf))
        return parsed.filter(F.col("action") == action).select("event_seq", "user", "source_ip", "destination_port", "message")

    return run


_extract("o03_failed_login", "FAILED_LOGIN")
_extract("o04_accepted_login", "ACCEPTED_LOGIN")
_extract("o05_sudo_command", "SUDO_COMMAND")
_extract("o06_connection", "CONNECTION")
_extract("o07_firewall_block", "BLOCKED")


@query(
    "o08_syslog_ts",
    sql.with_ctes(
        """SELECT event_seq, ts_us // 1000000 * 1000000 AS ts_us, CAST(year(wall) AS BIGINT) AS wall_year,
  CAST(hour(wall) AS BIGINT) AS wall_hour, CAST(0 AS BIGINT) AS inferred FROM ev"""
    ),
)
def o08(spark, sf):
    events, _ = readers.normalize_lines(sec_lines(spark, sf), YEAR)
    return events.select(
        "event_seq", us(), F.year("event_wall").cast("bigint").alias("wall_year"), F.hour("event_wall").cast("bigint").alias("wall_hour"),
        F.col("ts_inferred").cast("int").cast("bigint").alias("inferred"),
    )


_OFFSETS = ("Z", "", "+05:30", "-0800", " bad")


@query(
    "o09_iso_ts",
    sql.with_ctes(
        """SELECT event_seq, CASE event_seq % 5 WHEN 4 THEN 0 WHEN 2 THEN ts_us // 1000 * 1000 - 19800000000
    WHEN 3 THEN ts_us // 1000 * 1000 + 28800000000 ELSE ts_us // 1000 * 1000 END AS ts_us,
  CASE WHEN event_seq % 5 = 4 THEN 0 ELSE ts_us // 1000 * 1000 END AS wall_us,
  CAST(event_seq % 5 = 4 AS BIGINT) AS inferred FROM ev"""
    ),
)
def o09(spark, sf):
    """The feed as JSON with each offset form in turn; the unreadable fifth falls back to the ingest time."""
    form = F.element_at(F.array(*[F.lit(o) for o in _OFFSETS]), (F.col("event_seq") % 5 + 1).cast("int"))
    text = F.concat(F.date_format("event_wall", "yyyy-MM-dd'T'HH:mm:ss.SSS"), form)
    docs = sec_events(spark, sf).select(
        "event_seq", F.to_json(F.struct(text.alias("timestamp"))).alias("value"), F.timestamp_seconds(F.lit(0)).alias("ingested_at")
    )
    events, _ = readers.normalize_docs(docs)
    wall = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("event_wall"))
    return events.select("event_seq", us(), wall.alias("wall_us"), F.col("ts_inferred").cast("int").cast("bigint").alias("inferred"))


@query(
    "o10_action_severity",
    sql.with_ctes("SELECT action, severity, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL UNION ALL SELECT action || '?', 'info', CAST(count(*) AS BIGINT) FROM ev GROUP BY ALL"),
)
def o10(spark, sf):
    """Known actions, and the same words made unknown."""
    a = sec_events(spark, sf).select("action")
    both = a.unionByName(a.select(F.concat("action", F.lit("?")).alias("action")))
    return both.groupBy("action", action_severity("action").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("o11_normalize_parsed", sql.with_ctes(_EVENT_SQL))
def o11(spark, sf):
    events, rejects = readers.normalize_lines(sec_lines(spark, sf), YEAR)
    return event_view(events)


@query(
    "o12_normalize_json",
    sql.with_ctes(
        """SELECT event_seq, ts_us // 1000000 * 1000000 AS ts_us, source_ip, CASE WHEN event_seq % 3 = 0 THEN 'OTHER' WHEN event_seq % 3 = 1 THEN 'X_' || action
    ELSE action END AS action, usr AS "user", port AS destination_port,
  CASE WHEN event_seq % 3 = 0 THEN 'info' WHEN event_seq % 3 = 1 THEN CASE WHEN event_seq % 2 = 0 THEN 'low' ELSE 'info' END
    ELSE severity END AS severity, CASE WHEN event_seq % 2 = 0 THEN hostname END AS origin
FROM ev"""
    ),
)
def o12(spark, sf):
    """JSON events with an absent, an unknown or a known lower-case action, and with or without severity and
    metadata."""
    third, half = F.col("event_seq") % 3, F.col("event_seq") % 2
    doc = F.to_json(
        F.struct(
            F.date_format("event_wall", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
            "source_ip",
            "user",
            "destination_port",
            F.when(third == 1, F.concat(F.lit("x_"), F.lower("action"))).when(third == 2, F.lower("action")).alias("action"),
            F.when(half == 0, "low").alias("severity"),
            F.when(half == 0, F.create_map(F.lit("origin"), F.col("hostname"))).alias("metadata"),
        )
    )
    docs = sec_events(spark, sf).select("event_seq", doc.alias("value"), "ingested_at")
    events, _ = readers.normalize_docs(docs)
    return events.select(
        "event_seq", us(), "source_ip", "action", "user", "destination_port", "severity",
        F.try_element_at("metadata", F.lit("origin")).alias("origin"),
    )


@query(
    "o13_reject_lines",
    """
WITH l AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)) AS line FROM l),
j AS (SELECT doc_id, CASE WHEN line = '' THEN 'empty'
  WHEN regexp_matches(line, '^[0-9A-Za-z_]{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}\\s+\\S+\\s+\\S+?(?:\\[\\d+\\])?:\\s+.+$') THEN NULL
  ELSE 'no_header' END AS reject_reason FROM t)
SELECT doc_id, reject_reason, CAST(count(*) AS BIGINT) AS n FROM j WHERE reject_reason IS NOT NULL GROUP BY ALL
""",
)
def o13(spark, sf):
    """Every line of every document is judged; the counts per document and reason."""
    _, rejects = nz.parse_syslog(document_lines(spark, sf))
    return rejects.groupBy(F.col("event_seq").alias("doc_id"), "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o13_reject_json",
    sql.with_ctes(
        """SELECT reject_reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_seq) AS BIGINT) AS seqs FROM (
  SELECT event_seq, CASE event_seq % 7 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'bad_field' WHEN 3 THEN 'bad_field'
    WHEN 4 THEN 'bad_field' WHEN 5 THEN 'no_header' ELSE 'none' END AS reject_reason FROM ev) GROUP BY 1"""
    ),
)
def o13_json(spark, sf):
    """Broken text, a bare list, null and non-object fields, a raw line without header, and good documents."""
    forms = ('{"action": ', "[1, 2]", '{"action": null}', '{"metadata": null}', '{"metadata": "x"}', '{"raw": "no header"}', '{"action": "other"}')
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_seq") % 7 + 1).cast("int"))
    docs = sec_events(spark, sf).select("event_seq", form.alias("value"), "ingested_at")
    events, rejects = readers.normalize_docs(docs)
    judged = rejects.select("event_seq", "reject_reason").unionByName(events.select("event_seq", F.lit("none").alias("reject_reason")))
    return judged.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_seq").alias("seqs"))


@query(
    "o14_severity_rank",
    sql.with_ctes(
        """SELECT upper(severity) AS word, CAST(CASE severity WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 1 END AS BIGINT) AS rank,
  CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL
UNION ALL SELECT severity || '!', CAST(1 AS BIGINT), CAST(count(*) AS BIGINT) FROM ev GROUP BY ALL"""
    ),
)
def o14(spark, sf):
    w = sec_events(spark, sf).select(F.upper("severity").alias("word"))
    both = w.unionByName(w.select(F.concat(F.lower("word"), F.lit("!")).alias("word")))
    return both.groupBy("word", severity_rank("word").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


_ALERT_SQL = """
SELECT sha256(rule_name || '|' || key || '|' || CAST(created_us AS BIGINT) || '|' || trigger_seq) AS alert_id, rule_name, severity, source_ip, usr AS "user",
  description, context, CAST(evidence_count AS BIGINT) AS evidence_count, 'new' AS status, CAST(created_us AS BIGINT) AS created_us,
  CAST(trigger_seq AS BIGINT) AS trigger_seq
FROM alerts
"""


def alert_view(a):
    return a.select(
        "alert_id", "rule_name", "severity", "source_ip", "user", "description", "context", "evidence_count", "status",
        us("created_at", "created_us"), "trigger_seq",
    )


@query("o15_make_alerts", sql.with_ctes(_ALERT_SQL + " WHERE rule_name = 'brute_force_ssh'", *_ALERTS))
def o15(spark, sf):
    return alert_view(rules.brute_force_alerts(sec_events(spark, sf), CFG))


@query(
    "o16_static_features",
    sql.with_ctes(
        """SELECT event_seq, CAST(hour(wall) AS BIGINT) AS hour_of_day, CAST(isodow(wall) >= 6 AS BIGINT) AS is_weekend,
  CAST(action = 'FAILED_LOGIN' AS BIGINT) AS is_failed_login, CAST(action = 'SUDO_COMMAND' AS BIGINT) AS is_sudo FROM ev"""
    ),
)
def o16(spark, sf):
    rows = sec_events(spark, sf).selectExpr("event_seq", *STATIC_FEATURES)
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in rows.columns])


# ---------------------------------------------------------------- joins


@query(
    "o17_enrich",
    sql.with_ctes(
        """SELECT e.event_seq, e.source_ip, CAST(coalesce(ti.score, 0) AS BIGINT) AS score, coalesce(ti.tags, '') AS tags,
  CAST(ti.ip IS NOT NULL AS BIGINT) AS malicious FROM ev e LEFT JOIN ti ON ti.ip = e.source_ip"""
    ),
)
def o17(spark, sf):
    return enriched(spark, sf).select(
        "event_seq", "source_ip", F.col("intel.reputation_score").cast("bigint").alias("score"),
        F.array_join("intel.tags", ", ").alias("tags"), F.col("intel.malicious").cast("int").cast("bigint").alias("malicious"),
    )


@query(
    "o17_enrich_large_feed",
    sql.with_ctes(
        """SELECT e.event_seq, e.source_ip, CAST(coalesce(ti.score, 0) AS BIGINT) AS score
FROM ev e LEFT JOIN ti ON ti.ip = e.source_ip"""
    ),
)
def o17_large(spark, sf):
    """The same join as for a feed that is too large to send to every task."""
    ev = enrich(sec_events(spark, sf), sec_intel(spark, sf), max_rows=0)
    return ev.select("event_seq", "source_ip", F.col("intel.reputation_score").cast("bigint").alias("score"))


@query("o18_drop_blocked", sql.with_ctes("SELECT event_seq, source_ip, action, ts_us FROM kept", _BLOCKS))
def o18(spark, sf):
    events = enriched(spark, sf)
    kept, _ = respond.drop_blocked(events, materialize(block_points(events, CFG)))
    return kept.select("event_seq", "source_ip", "action", us())


@query(
    "o19_route",
    sql.with_ctes(
        """SELECT a.rule_name, CAST(a.trigger_seq AS BIGINT) AS trigger_seq, a.key AS subject, CASE WHEN rule_name = 'privilege_escalation' THEN 'disable_compromised_user'
  ELSE 'block_malicious_ip' END AS playbook FROM alerts a""",
        *_ALERTS,
    ),
)
def o19(spark, sf):
    found = detect(enriched(spark, sf), CFG)
    routed = respond.route(respond.response_gate(found), respond.routes_table(spark))
    return routed.select("rule_name", "trigger_seq", F.coalesce("user", "source_ip").alias("subject"), "playbook")


@query(
    "o19_route_as_coded",
    sql.with_ctes(
        """SELECT rule_name, 'disable_compromised_user' AS playbook, CAST(count(*) AS BIGINT) AS n FROM alerts
WHERE rule_name = 'privilege_escalation' GROUP BY ALL""",
        *_ALERTS,
    ),
)
def o19_coded(spark, sf):
    found = detect(enriched(spark, sf), CFG)
    routed = respond.route(respond.response_gate(found), respond.routes_table(spark, ROUTES_AS_CODED))
    return routed.groupBy("rule_name", "playbook").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o21_brute_force_evidence",
    sql.with_ctes("SELECT key, CAST(trigger_seq AS BIGINT) AS trigger_seq, event_seq, ts_us FROM bfe", _BRUTE),
)
def o21_brute(spark, sf):
    ev = sec_events(spark, sf)
    rows = evidence_rows(bf.brute_force_firings(ev, CFG), bf.failed_logins(ev), "source_ip", BRUTE_US, CFG.bucket_factor * BRUTE_US)
    return rows.select("key", "trigger_seq", "event_seq", us())


@query(
    "o21_port_scan_evidence",
    sql.with_ctes("SELECT key, CAST(trigger_seq AS BIGINT) AS trigger_seq, event_seq, ts_us, port AS destination_port FROM pse", _SCAN),
)
def o21_scan(spark, sf):
    ev = sec_events(spark, sf)
    rows = evidence_rows(ps.port_scan_firings(ev, CFG), ps.port_events(ev, CFG), "source_ip", SCAN_US, CFG.bucket_factor * SCAN_US)
    return rows.select("key", "trigger_seq", "event_seq", us(), "destination_port")


# ---------------------------------------------------------------- rules


@query(
    "o22_brute_force_candidates",
    sql.with_ctes("SELECT key, ts_us, event_seq, q AS q_ts FROM bfc", _BRUTE),
)
def o22_candidates(spark, sf):
    return bf.brute_force_candidates(sec_events(spark, sf), CFG).select("key", "ts_us", "event_seq", "q_ts")


@query(
    "o22_brute_force_firings",
    sql.with_ctes("SELECT b.key, b.ts_us, b.event_seq FROM bff f JOIN bf b ON b.key = f.key AND b.i = f.i", _BRUTE),
)
def o22_firings(spark, sf):
    return bf.brute_force_firings(sec_events(spark, sf), CFG).select("key", "ts_us", "event_seq")


@query(
    "o22_brute_force_alerts",
    sql.with_ctes(
        """SELECT key AS source_ip, CAST(trigger_seq AS BIGINT) AS trigger_seq, CAST(trigger_ts AS BIGINT) AS created_us, CAST(count(*) AS BIGINT) AS attempt_count,
  string_agg(DISTINCT usr, ',' ORDER BY usr) AS targeted_users, string_agg(CAST(event_seq AS VARCHAR), ',' ORDER BY ts_us, event_seq) AS evidence
FROM bfe GROUP BY key, trigger_seq, trigger_ts""",
        _BRUTE,
    ),
)
def o22_alerts(spark, sf):
    return rules.brute_force_alerts(sec_events(spark, sf), CFG).select(
        "source_ip", "trigger_seq", us("created_at", "created_us"), F.col("metadata.attempt_count").alias("attempt_count"),
        joined("metadata.targeted_users", "targeted_users"), joined("evidence.event_seq", "evidence"),
    )


@query(
    "o23_port_scan_firings",
    sql.with_ctes("SELECT b.key, b.ts_us, b.event_seq FROM psf f JOIN ps b ON b.key = f.key AND b.i = f.i", _SCAN),
)
def o23_firings(spark, sf):
    return ps.port_scan_firings(sec_events(spark, sf), CFG).select("key", "ts_us", "event_seq")


@query(
    "o23_port_scan_alerts",
    sql.with_ctes(
        """SELECT key AS source_ip, CAST(trigger_seq AS BIGINT) AS trigger_seq, CAST(trigger_ts AS BIGINT) AS created_us, CAST(count(DISTINCT port) AS BIGINT) AS unique_port_count,
  replace(trim(CAST(list_sort(list(DISTINCT port)) AS VARCHAR), '[]'), ' ', '') AS ports_scanned,
  string_agg(CAST(event_seq AS VARCHAR), ',' ORDER BY ts_us, event_seq) AS evidence
FROM pse GROUP BY key, trigger_seq, trigger_ts""",
        _SCAN,
    ),
)
def o23_alerts(spark, sf):
    return rules.port_scan_alerts(sec_events(spark, sf), CFG).select(
        "source_ip", "trigger_seq", us("created_at", "created_us"), F.col("metadata.unique_port_count").alias("unique_port_count"),
        joined("metadata.ports_scanned", "ports_scanned"), joined("evidence.event_seq", "evidence"),
    )


@query(
    "o24_escalation_firings",
    sql.with_ctes("SELECT b.key, b.ts_us, b.event_seq FROM pef f JOIN pe b ON b.key = f.key AND b.i = f.i", _ESC),
)
def o24_firings(spark, sf):
    return pe.escalation_firings(sec_events(spark, sf), CFG).select("key", "ts_us", "event_seq")


@query(
    "o24_escalation_alerts",
    sql.with_ctes(
        """SELECT key AS "user", CAST(trigger_seq AS BIGINT) AS trigger_seq, CAST(trigger_ts AS BIGINT) AS created_us, CAST(count(*) - 1 AS BIGINT) AS failed_auth_count,
  '/bin/run' || min(command) AS sudo_command, string_agg(CAST(event_seq AS VARCHAR), ',' ORDER BY ts_us, event_seq) AS evidence
FROM pee GROUP BY key, trigger_seq, trigger_ts""",
        _ESC,
    ),
)
def o24_alerts(spark, sf):
    return rules.escalation_alerts(sec_events(spark, sf), CFG).select(
        "user", "trigger_seq", us("created_at", "created_us"), F.col("metadata.failed_auth_count").alias("failed_auth_count"),
        F.col("metadata.sudo_command").alias("sudo_command"), joined("evidence.event_seq", "evidence"),
    )


_CFG2 = CFG.with_(escalation_min_failures=2, escalation_lookback_s=48 * HOUR)


@query(
    "o24_escalation_two_failures",
    sql.with_ctes(
        "SELECT b.key, b.ts_us, b.event_seq FROM pef f JOIN pe b ON b.key = f.key AND b.i = f.i",
        sql.escalation_ctes("ev", 2, 48 * HOUR * SECOND_US),
    ),
)
def o24_two(spark, sf):
    """Two failures in 48 hours: re-arming decides."""
    return pe.escalation_firings(sec_events(spark, sf), _CFG2).select("key", "ts_us", "event_seq")


@query("o25_intel_match", sql.with_ctes(_ALERT_SQL + " WHERE rule_name = 'threat_intel_match'", *_ALERTS))
def o25(spark, sf):
    return alert_view(rules.intel_alerts(enriched(spark, sf), CFG))


@query("o26_anomaly_alerts")
def o26(spark, sf):
    """Outlier alerts of a forest fitted on the newest events."""
    ev = sec_events(spark, sf)
    model = fit_model(feature_matrix(training_set(ev), CFG))
    found = anomaly_alerts(ev, model, CFG)
    f = F.col("metadata.features")
    return alert_view(found).drop("context").join(
        found.select("alert_id", f.velocity_60s.alias("velocity_60s"), f.unique_ports_60s.alias("unique_ports_60s")), "alert_id"
    )


@query("o26b_detect_all", sql.with_ctes(_ALERT_SQL, *_ALERTS))
def o26b(spark, sf):
    """All rules with an SQL form over the enriched feed."""
    return alert_view(detect(enriched(spark, sf), CFG))


def _broken_rule(events, cfg):
    """A rule that fails while it runs, not when it is defined."""
    return rules.intel_alerts(events, cfg).withColumn("context", F.raise_error(F.lit("broken rule")).cast("string"))


def _isolated(spark, sf):
    path = new_path(spark, "events")
    ev = enriched(spark, sf)
    tables.write_events(ev, path)
    return run_rules(tables.read_events(spark, path).select(*ev.columns), CFG, extra={"broken": _broken_rule})


@query("o26b_isolated_rules", sql.with_ctes(_ALERT_SQL, *_ALERTS))
def o26b_isolated(spark, sf):
    """Rules as jobs of their own over a stored table; one that raises leaves the alerts of the others."""
    return alert_view(_isolated(spark, sf).alerts)


@query(
    "o26b_rule_status",
    sql.with_ctes(
        """SELECT r.job, CASE WHEN r.job = 'broken' THEN 'failed' ELSE 'done' END AS state, count(a.rule_name) AS alerts
FROM (VALUES ('intel', 'threat_intel_match'), ('brute', 'brute_force_ssh'), ('scan', 'port_scan'),
  ('escalation', 'privilege_escalation'), ('broken', NULL)) r(job, rule_name)
LEFT JOIN alerts a ON a.rule_name = r.rule_name GROUP BY r.job""",
        *_ALERTS,
    ),
)
def o26b_status(spark, sf):
    return _isolated(spark, sf).status.drop("error")


@query("batch_alerts_after_blocks", sql.with_ctes(_ALERT_SQL, *_KEPT_ALERTS))
def batch_alerts(spark, sf):
    """The two-pass job: sources are blocked at their first alert, and the rules run on what is left."""
    return alert_view(run_batch(enriched(spark, sf), CFG).alerts)


@query("batch_mitigations", sql.with_ctes(_MITIGATION_SQL, *_KEPT_ALERTS))
def batch_mitigations(spark, sf):
    return mitigation_view(run_batch(enriched(spark, sf), CFG).mitigations)


# ---------------------------------------------------------------- response


@query(
    "o27_webhook_payload",
    sql.with_ctes(
        """SELECT CAST(trigger_seq AS BIGINT) AS trigger_seq, rule_name, CASE severity WHEN 'critical' THEN '\U0001f525 **SECURITY ALERT** \U0001f525'
    ELSE '\U0001f6a8 **SECURITY ALERT** \U0001f6a8' END AS text,
  'Rule Triggered: ' || rule_name AS title, 'danger' AS color, upper(severity) AS severity_value, source_ip AS source_value,
  coalesce(description, 'No description provided') AS description_value, CAST(evidence_count AS VARCHAR) AS count_value
FROM alerts""",
        *_ALERTS,
    ),
)
def o27(spark, sf):
    """Payload texts of all alerts, taken apart by JSON path."""
    rows = respond.webhook_payload(detect(enriched(spark, sf), CFG))

    def at(path, name):
        return F.get_json_object("payload", path).alias(name)

    return rows.select(
        "trigger_seq", "rule_name", at("$.text", "text"), at("$.attachments[0].title", "title"), at("$.attachments[0].color", "color"),
        at("$.attachments[0].fields[0].value", "severity_value"), at("$.attachments[0].fields[1].value", "source_value"),
        at("$.attachments[0].fields[2].value", "description_value"), at("$.attachments[0].fields[3].value", "count_value"),
    )


@query(
    "o28_dispatch",
    sql.with_ctes(
        """SELECT CAST(trigger_seq AS BIGINT) AS trigger_seq, rule_name, severity, destination
FROM alerts, (VALUES ('chat'), ('pager')) d(destination) WHERE severity = 'critical'""",
        *_ALERTS,
    ),
)
def o28(spark, sf):
    found = detect(enriched(spark, sf), CFG)
    return respond.dispatch(found, ["chat", "pager"], "critical").select("trigger_seq", "rule_name", "severity", "destination")


@query(
    "o29_response_gate",
    sql.with_ctes("SELECT CAST(event_seq AS BIGINT) AS event_seq, severity FROM ev WHERE severity = 'high'"),
)
def o29(spark, sf):
    """The gate over the feed's own severities."""
    rows = sec_events(spark, sf).withColumn("rule_name", F.lit("any"))
    return respond.response_gate(rows).select("event_seq", "severity")


@query(
    "o30_block_ip",
    sql.with_ctes(_MITIGATION_SQL + " WHERE rule_name <> 'privilege_escalation'", *_ALERTS),
)
def o30(spark, sf):
    routed = respond.route(respond.response_gate(detect(enriched(spark, sf), CFG)), respond.routes_table(spark))
    return mitigation_view(respond.block_ip(routed))


@query("o31_disable_user", sql.with_ctes(_MITIGATION_SQL + " WHERE rule_name = 'privilege_escalation'", *_ALERTS))
def o31(spark, sf):
    routed = respond.route(rules.escalation_alerts(sec_events(spark, sf), CFG), respond.routes_table(spark))
    return mitigation_view(respond.disable_user(routed))


@query(
    "o31_disable_user_from_evidence",
    sql.with_ctes(
        "SELECT 'unknown_actor' AS target, CAST(count(*) AS BIGINT) AS n FROM alerts WHERE rule_name = 'privilege_escalation'", *_ALERTS
    ),
)
def o31_evidence(spark, sf):
    """The user as the raw text shows it: the feed has neither of the two accounts."""
    routed = respond.route(rules.escalation_alerts(sec_events(spark, sf), CFG), respond.routes_table(spark))
    return respond.disable_user(routed, respond.user_from_evidence).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("o32_first_blocks", sql.with_ctes("SELECT source_ip, block_ts, block_seq FROM blk", _BLOCKS))
def o32(spark, sf):
    return block_points(enriched(spark, sf), CFG).select("source_ip", "block_ts", "block_seq")


# ---------------------------------------------------------------- features and model


@query(
    "o33_training_set",
    sql.with_ctes("SELECT event_seq, ts_us, source_ip, action FROM ev ORDER BY ts_us DESC, event_seq DESC LIMIT 10000"),
)
def o33(spark, sf):
    return training_set(sec_events(spark, sf)).select("event_seq", us(), "source_ip", "action")


_VELOCITY = f"""CASE WHEN source_ip IS NULL THEN 0 ELSE CAST(count(*) OVER (PARTITION BY source_ip ORDER BY ts_us
    RANGE BETWEEN {FEAT_US - 1} PRECEDING AND CURRENT ROW) AS BIGINT) END"""
_PORTS_CTE = f"""
pw AS (
  SELECT a.event_seq, CAST(count(DISTINCT b.port) AS BIGINT) AS distinct_ports
  FROM ev a LEFT JOIN ev b ON b.source_ip = a.source_ip AND b.ts_us <= a.ts_us AND b.ts_us > a.ts_us - {FEAT_US} AND b.port <> -1
  GROUP BY a.event_seq)
"""


@query("o34_velocity", sql.with_ctes(f"SELECT event_seq, {_VELOCITY} AS velocity FROM ev"))
def o34(spark, sf):
    return window_features(sec_events(spark, sf), CFG).select("event_seq", "velocity")


@query("o35_distinct_ports", sql.with_ctes("SELECT event_seq, distinct_ports FROM pw", _PORTS_CTE))
def o35(spark, sf):
    return window_features(sec_events(spark, sf), CFG).select("event_seq", "distinct_ports")


@query(
    "o36_feature_matrix",
    sql.with_ctes(
        f"""SELECT event_seq, CAST(hour(wall) AS BIGINT) AS hour_of_day, CAST(isodow(wall) >= 6 AS BIGINT) AS is_weekend,
  CAST(action = 'FAILED_LOGIN' AS BIGINT) AS is_failed_login, CAST(action = 'SUDO_COMMAND' AS BIGINT) AS is_sudo,
  {_VELOCITY} AS velocity_60s, distinct_ports AS unique_ports_60s FROM ev JOIN pw USING (event_seq)""",
        _PORTS_CTE,
    ),
)
def o36(spark, sf):
    m = feature_matrix(sec_events(spark, sf), CFG)
    return m.select(*[F.col(c).cast("bigint").alias(c) for c in m.columns])


@query("o37_fit_iforest")
def o37(spark, sf):
    """Node table of the forest over the newest events."""
    return fit_iforest(feature_matrix(training_set(sec_events(spark, sf)), CFG))


@query("o38_iforest_score")
def o38(spark, sf):
    """Outlier score of every event."""
    m = feature_matrix(sec_events(spark, sf), CFG)
    return score(m, materialize(fit_iforest(m))).select("event_seq", "score")


@query(
    "o39_score_threshold",
    sql.with_ctes("SELECT quantile_cont(CAST(k AS DOUBLE), 0.95) AS threshold FROM ev"),
)
def o39_threshold(spark, sf):
    """The threshold rule on a score that SQL has too."""
    scores = sec_events(spark, sf).select(F.regexp_extract("raw", r"(?:run|port |DPT=)(\d+)", 1).cast("double").alias("score"))
    return score_threshold(scores)


@query("o39_predict")
def o39(spark, sf):
    """Events flagged by a model of all events: at most 5 % of them."""
    m = feature_matrix(sec_events(spark, sf), CFG)
    return predict(m, fit_model(m)).groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- read queries


@query(
    "o41_list_alerts",
    sql.with_ctes(_ALERT_SQL + " WHERE severity = 'critical' ORDER BY created_us DESC, alert_id LIMIT 50 OFFSET 10", *_ALERTS),
)
def o41(spark, sf):
    return alert_view(reads.list_alerts(detect(enriched(spark, sf), CFG), "new", "critical", 50, 10))


@query(
    "o42_list_events",
    sql.with_ctes("SELECT event_seq, ts_us, source_ip, action FROM ev ORDER BY ts_us DESC, event_seq DESC LIMIT 100"),
)
def o42(spark, sf):
    return reads.list_events(sec_events(spark, sf)).select("event_seq", us(), "source_ip", "action")


@query(
    "o42_list_events_of_source",
    sql.with_ctes("SELECT event_seq, ts_us, source_ip, action FROM ev WHERE source_ip = '10.0.0.7' ORDER BY ts_us DESC, event_seq DESC LIMIT 100"),
)
def o42_source(spark, sf):
    return reads.list_events(sec_events(spark, sf), "10.0.0.7").select("event_seq", us(), "source_ip", "action")


@query(
    "o43_alert_stats",
    sql.with_ctes("SELECT severity, CAST(count(*) AS BIGINT) AS count FROM alerts GROUP BY severity", *_ALERTS),
)
def o43(spark, sf):
    return reads.alert_stats(detect(enriched(spark, sf), CFG))


@query(
    "o44_list_mitigations",
    sql.with_ctes(_MITIGATION_SQL + " ORDER BY ts_us DESC, triggering_alert_id, action LIMIT 100", *_ALERTS),
)
def o44(spark, sf):
    m = respond.mitigations(detect(enriched(spark, sf), CFG), respond.routes_table(spark))
    return mitigation_view(reads.list_mitigations(m, 100))


@query(
    "o45_ingest_summary",
    sql.with_ctes(
        """SELECT CAST((SELECT count(*) FROM kept) AS BIGINT) AS ingested,
  CAST((SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)) AS BIGINT) AS failed,
  CAST((SELECT count(*) FROM gone) AS BIGINT) AS dropped, CAST((SELECT count(*) FROM alerts) AS BIGINT) AS alerts_triggered""",
        *_KEPT_ALERTS,
    ),
)
def o45(spark, sf):
    """One load of the feed, with every document line as unreadable input."""
    result = run_batch(enriched(spark, sf), CFG)
    _, rejects = nz.parse_syslog(document_lines(spark, sf))
    return reads.ingest_summary(result.kept, rejects, result.dropped, result.alerts)


@query(
    "o46_engine_stats",
    sql.with_ctes(
        """SELECT e AS events_processed, a AS alerts_generated, CAST((SELECT count(*) FROM
  (VALUES ('threat_intel_match'), ('brute_force_ssh'), ('port_scan'), ('privilege_escalation'))) AS BIGINT) AS rules_loaded, printf('%.2f%%', a / e * 100) AS alert_rate
FROM (SELECT CAST((SELECT count(*) FROM ev) AS BIGINT) AS e, CAST((SELECT count(*) FROM alerts) AS BIGINT) AS a)""",
        *_ALERTS,
    ),
)
def o46(spark, sf):
    events = enriched(spark, sf)
    return reads.engine_stats(events, detect(events, CFG), len(rule_set()))


@query(
    "o47_rule_catalogue",
    sql.with_ctes(
        """SELECT r.name, r.severity, CAST(count(a.rule_name) AS BIGINT) AS alerts FROM (VALUES ('threat_intel_match', 'critical'),
  ('brute_force_ssh', 'high'), ('port_scan', 'high'), ('privilege_escalation', 'critical'), ('ml_behavioral_anomaly', 'high')) r(name, severity)
LEFT JOIN alerts a ON a.rule_name = r.name GROUP BY ALL""",
        *_ALERTS,
    ),
)
def o47(spark, sf):
    """The catalogue with each rule's alerts over the feed."""
    counts = detect(enriched(spark, sf), CFG).groupBy(F.col("rule_name").alias("name")).agg(F.count(F.lit(1)).alias("alerts"))
    return reads.rule_catalogue(spark, CFG).join(counts, "name", "left").select("name", "severity", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query(
    "o48_dashboard",
    sql.with_ctes(
        """SELECT CAST((SELECT count(*) FROM ev) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS alerts,
  CAST(count(*) AS BIGINT) AS high_risk_alerts, CAST(count(*) AS BIGINT) AS mitigations FROM alerts""",
        *_ALERTS,
    ),
)
def o48(spark, sf):
    events = enriched(spark, sf)
    found = materialize(detect(events, CFG))
    return reads.dashboard(events, found, respond.mitigations(found, respond.routes_table(spark)))


@query(
    "o49_flatten_evidence",
    sql.with_ctes(
        """SELECT sha256('privilege_escalation|' || p.key || '|' || (SELECT CAST(ts_us AS BIGINT) FROM ev t WHERE t.event_seq = p.trigger_seq) || '|' || p.trigger_seq) AS alert_id, p.ts_us, e.source_ip, p.action, p.event_seq
FROM pee p JOIN ev e USING (event_seq)""",
        _ESC,
    ),
)
def o49(spark, sf):
    flat = reads.flatten_evidence(rules.escalation_alerts(sec_events(spark, sf), CFG))
    return flat.select("alert_id", us(), "source_ip", "action", "event_seq")


@query(
    "o50_targeted_users",
    sql.with_ctes(
        """SELECT key, CAST(trigger_seq AS BIGINT) AS trigger_seq, string_agg(DISTINCT coalesce(usr, 'unknown'), ',' ORDER BY coalesce(usr, 'unknown')) AS users
FROM pse GROUP BY key, trigger_seq""",
        _SCAN,
    ),
)
def o50(spark, sf):
    """Users met by each port scan: connections carry none, so ``unknown`` shows up."""
    ev = sec_events(spark, sf)
    rows = evidence_rows(ps.port_scan_firings(ev, CFG), ps.port_events(ev, CFG), "source_ip", SCAN_US, CFG.bucket_factor * SCAN_US)
    return reads.targeted_users(rows).select("key", "trigger_seq", joined("users", "users"))
