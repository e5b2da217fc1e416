"""Rule cases by hand, alerts, routing, payloads, reads and tables."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden.config import DetectConfig
from sparkwarden.operators import alerts as rules
from sparkwarden.operators import reads, respond
from sparkwarden.operators.enrich import enrich, sample_intel
from sparkwarden.schema import ROUTES_AS_CODED, ROUTES_INTENDED
from sparkwarden.sources import tables
from tests.helpers import events_df


def ev(seq, ts, action="FAILED_LOGIN", ip="1.1.1.1", user="root", port=22, message=None):
    return dict(seq=seq, ts=ts, action=action, ip=ip, user=user, port=port, message=message)


def many(n, step=1, start=0, seq=0, **kw):
    return [ev(seq + i, start + i * step, **kw) for i in range(n)]


BRUTE = {
    "at threshold": (many(5), 1),
    "below": (many(4), 0),
    "other action": (many(10, action="ACCEPTED_LOGIN"), 0),
    "expired": (many(3) + many(2, start=120, seq=3), 0),
    "two sources": (many(3) + many(3, seq=3, ip="2.2.2.2"), 0),
    "re-arm": (many(5) + many(5, start=30, seq=5), 2),
    "oldest exactly one window back": ([ev(0, 0)] + many(4, start=57, seq=1), 1),
    "one second too old": ([ev(0, 0)] + many(4, start=58, seq=1), 0),
    "same second": (many(5, step=0), 1),
    "null user": (many(5, user=None), 1),
    "null source": (many(5, ip=None), 0),
}
SCAN = {
    "ten ports": ([ev(i, i, "BLOCKED", port=i) for i in range(10)], 1),
    "five ports": ([ev(i, i, "BLOCKED", port=i) for i in range(5)], 0),
    "one port": (many(15, action="CONNECTION"), 0),
    "no port": (many(15, action="CONNECTION", port=None), 0),
}
SUDO = {
    "failure then sudo": ([ev(0, 0), ev(1, 30, "SUDO_COMMAND", ip=None, message="/bin/sh")], 1),
    "sudo alone": ([ev(1, 30, "SUDO_COMMAND")], 0),
    "other user": ([ev(0, 0, user="a"), ev(1, 30, "SUDO_COMMAND", user="b")], 0),
    "expired": ([ev(0, 0), ev(1, 600, "SUDO_COMMAND")], 0),
    "second sudo": ([ev(0, 0), ev(1, 30, "SUDO_COMMAND"), ev(2, 31, "SUDO_COMMAND")], 1),
    "null user": ([ev(0, 0, user=None), ev(1, 30, "SUDO_COMMAND", user=None)], 0),
}


def check(spark, cases, rule):
    """All cases at once: each gets a source and user of its own."""
    events, want = [], {}
    for n, (name, (rows, alerts)) in enumerate(cases.items()):
        want[name] = alerts
        for r in rows:
            events.append({
                **r,
                "seq": n * 1000 + r["seq"],
                "ip": r["ip"] and f"{n}-{r['ip']}",
                "user": r["user"] and f"{n}-{r['user']}",
            })
    found = rule(events_df(spark, events), DetectConfig()).collect()
    got = dict.fromkeys(cases, 0)
    for a in found:
        got[list(cases)[a.trigger_seq // 1000]] += 1
    assert got == want
    return found


def test_brute_force_cases(spark):
    found = check(spark, BRUTE, rules.brute_force_alerts)
    assert {a.severity for a in found} == {"high"}
    first = next(a for a in found if a.trigger_seq == 4)
    assert first.evidence_count == 5 and [e.event_seq for e in first.evidence] == [0, 1, 2, 3, 4]
    assert "5 failed login attempts from 0-1.1.1.1 within 60 seconds" in first.description
    nameless = next(a for a in found if a.source_ip.startswith("9-"))
    assert nameless.metadata.targeted_users == ["unknown"]


def test_port_scan_cases(spark):
    (a,) = check(spark, SCAN, rules.port_scan_alerts)
    assert a.metadata.ports_scanned == list(range(10)) and a.evidence_count == 10
    assert a.description.endswith("Ports: [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]")


def test_escalation_cases(spark):
    found = check(spark, SUDO, rules.escalation_alerts)
    a = next(x for x in found if x.trigger_seq == 1)
    assert a.severity == "critical" and a.source_ip == "local" and a.metadata.sudo_command == "/bin/sh"
    assert [e.action for e in a.evidence] == ["FAILED_LOGIN", "SUDO_COMMAND"] and a.metadata.failed_auth_count == 1
    assert "User '0-root' executed sudo command after 1 failed" in a.description


def test_port_scan_evidence_keeps_repeats_and_cap(spark):
    rows = [ev(i, 0, "CONNECTION", port=1) for i in range(50)] + [ev(50 + i, 1, "CONNECTION", port=2 + i) for i in range(9)]
    (a,) = rules.port_scan_alerts(events_df(spark, rows)).collect()
    assert a.evidence_count == 59 and len(a.evidence) == 59
    (c,) = rules.port_scan_alerts(events_df(spark, rows), DetectConfig(evidence_cap=3)).collect()
    assert c.evidence_count == 59 and [e.event_seq for e in c.evidence] == [56, 57, 58]
    assert c.metadata.ports_scanned == list(range(1, 11))


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_intel(spark, max_rows):
    rows = [ev(0, 0, ip="185.220.101.1"), ev(1, 1, ip="104.244.72.100"), ev(2, 2, ip="9.9.9.9"), ev(3, 3, ip=None)]
    e = enrich(events_df(spark, rows), sample_intel(spark), max_rows=max_rows)
    got = {r.event_seq: (r.intel.reputation_score, r.intel.malicious) for r in e.collect()}
    assert got == {0: (95, True), 1: (75, True), 2: (0, False), 3: (0, False)}
    (a,) = rules.intel_alerts(e).collect()
    assert a.trigger_seq == 0 and a.severity == "critical" and a.description is None
    assert a.context.endswith("Reputation Score: 95. Tags: [TOR_EXIT_NODE, ANONYMIZER]")


def test_repeated_intel_rows_keep_events_single(spark):
    feed = sample_intel(spark)
    more = feed.unionByName(feed.withColumn("reputation_score", F.lit(3))).unionByName(feed.withColumn("ip", F.lit(None).cast("string")))
    e = enrich(events_df(spark, [ev(0, 0, ip="185.220.101.1"), ev(1, 1, ip=None)]), more).collect()
    assert sorted((r.event_seq, r.intel.reputation_score) for r in e) == [(0, 95), (1, 0)]


def test_loads_with_equal_numbers_give_other_ids(spark):
    days = [rules.intel_alerts(enrich(events_df(spark, [ev(0, 86_400 * d, ip="185.220.101.1")]), sample_intel(spark))) for d in (0, 1)]
    assert len({a.alert_id for day in days for a in day.collect()}) == 2


def alert_rows(spark):
    rows = [
        ("a", "brute_force_ssh", "high", "1.1.1.1", "text", 5, 1),
        ("b", "privilege_escalation", "critical", "local", None, 2, 2),
        ("c", "x", "medium", None, None, None, 3),
        ("d", "x", "low", "2.2.2.2", None, 0, 4),
        ("e", None, "high", "2.2.2.2", None, 1, 5),
    ]
    return spark.createDataFrame(
        rows, "alert_id string, rule_name string, severity string, source_ip string, description string, "
        "evidence_count bigint, t bigint"
    ).withColumns({
        "created_at": F.timestamp_seconds("t"),
        "status": F.lit("new"),
        "metadata": F.expr("named_struct('user', if(alert_id = 'b', 'eve', null))"),
    })


def test_dispatch_and_payload(spark):
    a = alert_rows(spark)
    ids = lambda df: sorted(r.alert_id for r in df.collect())
    assert ids(respond.dispatch(a, ["w"])) == ["a", "b", "e"]
    assert ids(respond.dispatch(a, ["w", "v"], "critical")) == ["b", "b"]
    assert ids(respond.dispatch(a, ["w"], "nonsense")) == ["a", "b", "e"]
    assert ids(respond.dispatch(a, ["w"], "info")) == ["a", "b", "c", "d", "e"]
    assert ids(respond.dispatch(a, [])) == []
    p = {r.alert_id: json.loads(r.payload) for r in respond.webhook_payload(a, "HELLO").collect()}
    assert p["b"]["text"] == "\U0001f525 **HELLO** \U0001f525" and p["a"]["attachments"][0]["color"] == "danger"
    c = p["c"]["attachments"][0]
    assert c["color"] == "warning" and c["title"] == "Rule Triggered: x"
    assert [f["value"] for f in c["fields"]] == ["MEDIUM", "unknown", "No description provided", "0"]
    assert [f["short"] for f in c["fields"]] == [True, True, False, True]


def test_routes_and_mitigations(spark):
    a = alert_rows(spark)
    intended = respond.mitigations(a, respond.routes_table(spark, ROUTES_INTENDED)).collect()
    assert sorted((m.action, m.target, m.triggering_alert_id) for m in intended) == [
        ("BLOCK_IP", "1.1.1.1", "a"), ("DISABLE_USER", "eve", "b")]
    coded = respond.mitigations(a, respond.routes_table(spark, ROUTES_AS_CODED)).collect()
    assert [(m.action, m.reason) for m in coded] == [
        ("DISABLE_USER", "Auto-mitigation due to privilege_escalation (Compromised Credentials).")]
    extra = respond.Playbook("ticket", ("brute_force_ssh",), lambda df: df.select(
        F.col("created_at").alias("timestamp"), "playbook", F.lit("TICKET").alias("action"), F.col("source_ip").alias("target"),
        F.lit("r").alias("reason"), F.col("alert_id").alias("triggering_alert_id"), F.lit("applied").alias("status")))
    more = respond.mitigations(a, respond.routes_table(spark), [extra])
    assert more.filter("action = 'TICKET'").count() == 1


def test_user_from_evidence(spark):
    def case(*raws):
        return [("FAILED_LOGIN", r) for r in raws]

    rows = [(0, case("x for sysadmin", "y")), (1, case("x for sysadmin", "z for root")), (2, case("nobody")),
            (3, [("CONNECTION", "for root"), ("SUDO_COMMAND", "sysadmin : TTY")])]
    df = spark.createDataFrame(rows, "i int, evidence array<struct<action:string,raw:string>>")
    got = [r[0] for r in df.orderBy("i").select(respond.user_from_evidence()).collect()]
    assert got == ["sysadmin", "root", "unknown_actor", "sysadmin"]


def test_reads(spark):
    a = alert_rows(spark)
    assert [r.alert_id for r in reads.list_alerts(a, limit=2, skip=1).collect()] == ["d", "c"]
    assert [r.alert_id for r in reads.list_alerts(a, severity="high").collect()] == ["e", "a"]
    assert reads.list_alerts(a, status="resolved").count() == 0
    assert [(r.severity, r["count"]) for r in reads.alert_stats(a).collect()][0] == ("high", 2)
    none = a.filter("false")
    assert reads.engine_stats(none, none, 4).first().alert_rate == "0%"
    assert reads.engine_stats(a, a.limit(2), 4).first()[2:] == (4, "40.00%")
    assert reads.rule_catalogue(spark).count() == 5
    d = reads.dashboard(a, a, none).first()
    assert (d.events, d.alerts, d.high_risk_alerts, d.mitigations) == (5, 5, 3, 0)


def test_tables_are_idempotent(spark, tmp_path):
    a = alert_rows(spark)
    for part in (a.filter("t <= 3"), a, a):
        tables.write_alerts(part, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 5
    for _ in range(2):
        tables.write_outbox(a, str(tmp_path / "outbox"), ["w", "v"])
    assert spark.read.parquet(str(tmp_path / "outbox")).count() == 6
