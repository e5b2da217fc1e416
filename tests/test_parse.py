"""Line grammar, JSON path and rejects."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import normalize as nz
from sparkwarden.sources import readers

HEAD = "Mar 30 14:23:45 server01 sshd[12345]: "

# line -> action, user, source_ip, port, message (None: not compared)
LINES = {
    HEAD + "Failed password for root from 192.168.1.100 port 22 ssh2": ("FAILED_LOGIN", "root", "192.168.1.100", 22, None),
    HEAD + "Failed password for invalid user test from 10.1.2.3 port 4242 ssh2": ("FAILED_LOGIN", "test", "10.1.2.3", 4242, None),
    HEAD + "Accepted password for admin from 10.0.0.50 port 22 ssh2": ("ACCEPTED_LOGIN", "admin", "10.0.0.50", 22, None),
    HEAD + "Accepted publickey for dev from 10.0.0.51 port 1 ssh2": ("ACCEPTED_LOGIN", "dev", "10.0.0.51", 1, None),
    "Mar 30 14:23:45 h sudo[9]: deploy : TTY=pts/0 ; PWD=/home/deploy ; USER=root ; COMMAND=/bin/ls -l": (
        "SUDO_COMMAND", "deploy", None, None, "/bin/ls -l"),
    HEAD + "connection from 10.0.0.9 port 80": ("CONNECTION", None, "10.0.0.9", 80, None),
    HEAD + "Connection from 10.0.0.9 on port 81": ("CONNECTION", None, "10.0.0.9", 81, None),
    HEAD + "BLOCKED IN=eth0 SRC=203.0.113.50 DST=10.0.0.1 DPT=443 PROTO=TCP": ("BLOCKED", None, "203.0.113.50", 443, None),
    HEAD + "DROP x SRC=1.1.1.1 y SRC=2.2.2.2 z DPT=1 DPT=2": ("BLOCKED", None, "2.2.2.2", 2, None),
    HEAD + "session opened": ("OTHER", None, None, None, "session opened"),
    # the first form wins wherever it stands
    HEAD + "connection from 9.9.9.9 port 9 then Failed password for bob from 1.2.3.4 port 5": (
        "FAILED_LOGIN", "bob", "1.2.3.4", 5, None),
    HEAD + "Failed password for root from nowhere port 22": ("OTHER", None, None, None, None),
    # a port beyond BIGINT is no port
    HEAD + "connection from 10.0.0.9 port 99999999999999999999": ("CONNECTION", None, "10.0.0.9", None, None),
    "  Mar  3 01:02:03 h kernel: BLOCKED a SRC=1.2.3.4 b DPT=7 \t": ("BLOCKED", None, "1.2.3.4", 7, None),
}
REJECTS = {"": "empty", "   \t ": "empty", "not a log line": "no_header", "Mar 30 14:23 host svc: x": "no_header", None: "empty"}


def lines_df(spark, lines):
    rows = [(i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "event_seq bigint, line string").withColumn(
        "ingested_at", F.timestamp_seconds(F.lit(1_700_000_000))
    )


def test_message_forms(spark):
    parsed, rejects = nz.parse_syslog(lines_df(spark, LINES))
    got = {r.event_seq: r for r in parsed.collect()}
    assert rejects.count() == 0
    for i, (line, (action, user, ip, port, message)) in enumerate(LINES.items()):
        r = got[i]
        assert (r.action, r.user, r.source_ip, r.destination_port) == (action, user, ip, port), line
        if message is not None:
            assert r.message == message


def test_header_fields(spark):
    r = nz.parse_header(lines_df(spark, [HEAD + "x: y", "Mar 3 01:02:03 h svc: z"])).orderBy("event_seq").collect()
    assert (r[0].clock, r[0].hostname, r[0].service, r[0].pid, r[0].message) == (
        "Mar 30 14:23:45", "server01", "sshd", "12345", "x: y")
    assert (r[1].service, r[1].pid) == ("svc", None)


def test_rejects(spark):
    parsed, rejects = nz.parse_syslog(lines_df(spark, REJECTS))
    assert parsed.count() == 0
    assert {r.event_seq: r.reject_reason for r in rejects.collect()} == dict(enumerate(REJECTS.values()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    clocks = ["Feb 29 01:02:03", "mar  3 01:02:03", "Foo 3 01:02:03", "Mar 3 25:00:00", "DEC 31 23:59:59"]
    df = lines_df(spark, [c + " h svc: m" for c in clocks])
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {}
        for year in (2023, 2024):
            events, _ = readers.normalize_lines(df, year)
            got[year] = {
                r.event_seq: (r.t, r.ts_inferred)
                for r in events.select("event_seq", F.unix_seconds("event_ts").alias("t"), "ts_inferred").collect()
            }
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def at(*args):
        return int(datetime(*args, tzinfo=timezone.utc).timestamp()), False

    lost = (1_700_000_000, True)
    assert got[2023] == {0: lost, 1: at(2023, 3, 3, 1, 2, 3), 2: lost, 3: lost, 4: at(2023, 12, 31, 23, 59, 59)}
    assert got[2024][0] == at(2024, 2, 29, 1, 2, 3)


DOCS = {
    '{"action": "failed_login", "source_ip": "1.2.3.4", "user": "a", "destination_port": "22", "severity": "low", '
    '"timestamp": "2024-01-02T03:04:05+02:00", "metadata": {"x": 1}}': ("FAILED_LOGIN", "1.2.3.4", 22, "medium", 3),
    '{"action": "odd", "severity": "high", "source_ip": ""}': ("ODD", None, None, "high", None),
    '{"destination_port": 80}': ("OTHER", None, 80, "info", None),
    '{"action": "odd", "destination_port": "n/a", "timestamp": "yesterday"}': ("ODD", None, None, "info", None),
    '{"raw": 5}': ("OTHER", None, None, "info", None),
}
BAD_DOCS = {"{": "bad_json", "[]": "bad_json", '"x"': "bad_json", '{"action": null}': "bad_field", '{"action": 3}': "bad_field",
            '{"metadata": null}': "bad_field", '{"metadata": []}': "bad_field", '{"raw": ""}': "empty"}


def docs_df(spark, docs):
    return lines_df(spark, docs).withColumnRenamed("line", "value")


def test_json_events(spark):
    events, rejects = readers.normalize_docs(docs_df(spark, DOCS))
    rows = {
        r.event_seq: (r.action, r.source_ip, r.destination_port, r.severity, None if r.ts_inferred else r.event_wall.hour)
        for r in events.collect()
    }
    assert rows == dict(enumerate(DOCS.values())) and rejects.count() == 0
    first = events.filter("event_seq = 0").select(F.unix_seconds("event_ts"), "metadata").first()
    assert first[0] == int(datetime(2024, 1, 2, 1, 4, 5, tzinfo=timezone.utc).timestamp()) and first[1] == {"x": "1"}


def test_bad_documents(spark):
    events, rejects = readers.normalize_docs(docs_df(spark, BAD_DOCS))
    assert events.count() == 0
    assert {r.event_seq: r.reject_reason for r in rejects.collect()} == dict(enumerate(BAD_DOCS.values()))


def test_raw_document_and_bulk_order(spark):
    line = HEAD + "Failed password for root from 1.1.1.1 port 22 ssh2"
    events, _ = readers.normalize_docs(docs_df(spark, ['{"raw": "%s"}' % line]))
    assert [r.action for r in events.collect()] == ["FAILED_LOGIN"]
    bulk = spark.createDataFrame(
        [(7, '{"events": [{"action": "connection"}, {"raw": "x"}], "logs": ["%s", "bad"]}' % line), (8, '{"logs": []}'), (9, "{}")],
        "batch_seq bigint, value string",
    ).withColumn("ingested_at", F.timestamp_seconds(F.lit(0)))
    events, rejects = readers.normalize_bulk(bulk)
    base = 7 << 24
    # lines come first; a bulk document is never read as a raw line
    assert sorted((r.event_seq, r.action) for r in events.collect()) == [
        (base, "FAILED_LOGIN"), (base + 2, "CONNECTION"), (base + 3, "OTHER")]
    assert [(r.event_seq, r.reject_reason) for r in rejects.collect()] == [(base + 1, "no_header")]


def test_broken_envelopes_are_rejects(spark):
    texts = ["not json", '{"logs": ["a"', "[1]", '{"logs": "x"}', '{"events": {}}', '{"events": null}', None, "{}", '{"logs": []}']
    rows = [(i, x) for i, x in enumerate(texts)]
    bulk = spark.createDataFrame(rows, "batch_seq bigint, value string").withColumn("ingested_at", F.timestamp_seconds(F.lit(0)))
    events, rejects = readers.normalize_bulk(bulk)
    assert events.count() == 0
    assert {r.event_seq >> 24: r.reject_reason for r in rejects.collect()} == (
        dict.fromkeys((0, 1, 2, 6), "bad_json") | dict.fromkeys((3, 4, 5), "bad_field"))


def test_bulk_numbers_never_repeat_silently(spark):
    for number in (1 << 39, -1):
        bulk = spark.createDataFrame([(number, '{"logs": ["a"]}')], "batch_seq bigint, value string").withColumn(
            "ingested_at", F.timestamp_seconds(F.lit(0)))
        with pytest.raises(Exception, match="no room"):
            readers.normalize_bulk(bulk)[1].collect()
