"""Streams against the batch rules: many small files, rows out of order inside the delay, restarts."""

import pytest
from pyspark.sql import functions as F

from sparkwarden.config import DetectConfig
from sparkwarden.operators.enrich import enrich
from sparkwarden.operators.features import feature_matrix
from sparkwarden.plans.batch import run_batch
from sparkwarden.sources.readers import stream_events
from sparkwarden.streaming import flows
from sparkwarden.streaming.state import OUT_DDL, stream_ip_rules, stream_user_rules
from tests.helpers import events_df, random_events
from tests.test_model_and_batch import CFG, intel

LAST = 10**6


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Events as files in arrival order, where rows arrive up to 4 s early or late; the last row closes the watermark."""
    ev = random_events(21, 10, 60, 150)
    arrival = sorted(ev, key=lambda e: e["ts"] + (e["seq"] * 7919 % 9 - 4))
    end = dict(seq=LAST, ts=100_000, ip="end", user="end", action="OTHER", port=None)
    path = str(tmp_path_factory.mktemp("feed"))
    for i in range(0, len(arrival), 60):
        enrich(events_df(spark, arrival[i : i + 60]), intel(spark)).coalesce(1).write.mode("append").parquet(path)
    enrich(events_df(spark, [end]), intel(spark)).coalesce(1).write.mode("append").parquet(path)
    return ev, path


def source(spark, path, delay="10 seconds"):
    schema = spark.read.parquet(path).schema
    return flows.with_lateness(stream_events(spark, path, schema, max_files=1), delay)


def test_stream_equals_batch(spark, feed, tmp_path):
    ev, path = feed
    flows.use_state_store(spark)
    out, users = str(tmp_path / "ip"), str(tmp_path / "user")
    flows.run_available(stream_ip_rules(source(spark, path), CFG), out + "-c", out)
    got = spark.read.parquet(out).filter("key != 'end'")
    want = run_batch(enrich(events_df(spark, ev), intel(spark)), CFG)
    kept = want.kept.filter("source_ip IS NOT NULL").select("event_seq")
    assert sorted(r[0] for r in got.filter("kind = 'kept'").select("event_seq").collect()) == sorted(r[0] for r in kept.collect())
    assert got.filter("kind = 'dropped'").count() == want.dropped.count() > 0
    fired = sorted((r.rule_name, r.event_seq) for r in got.filter("kind = 'fired'").collect())
    by_ip = want.alerts.filter("rule_name != 'privilege_escalation'")
    assert fired == sorted((r.rule_name, r.trigger_seq) for r in by_ip.collect())

    # the second stream, over what the first one kept and the events without a source; files follow each other in time
    columns = ("event_ts", "event_seq", "action", "user", "destination_port")
    kept = got.filter("kind = 'kept'").selectExpr(
        "timestamp_micros(ts_us) AS event_ts", "event_seq", "action", "user", "CAST(null AS bigint) AS destination_port"
    )
    local = want.kept.filter("source_ip IS NULL").select(*columns)
    end = local.limit(1).selectExpr(
        "event_ts + INTERVAL 1 DAY AS event_ts", "-1L AS event_seq", "'FAILED_LOGIN' AS action", "'end' AS user", "destination_port"
    )
    second = str(tmp_path / "kept")
    both = kept.unionByName(local).repartitionByRange(4, "event_ts")
    both.write.mode("append").parquet(second)
    end.write.mode("append").parquet(second)
    stream = flows.with_lateness(stream_events(spark, second, both.schema, max_files=10), "1000 seconds")
    flows.run_available(stream_user_rules(stream, CFG), users + "-c", users)
    got = sorted(r.event_seq for r in spark.read.parquet(users).collect())
    esc = want.alerts.filter("rule_name = 'privilege_escalation'")
    assert got == sorted(r.trigger_seq for r in esc.collect()) and got


def test_eager_equals_batch_in_arrival_order(spark, tmp_path):
    ev = sorted(random_events(22, 6, 50, 100), key=lambda e: (e["ts"], e["seq"]))
    for i, e in enumerate(ev):
        e["seq"] = i
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, len(ev), 60):
        enrich(events_df(spark, ev[i : i + 60]), intel(spark)).coalesce(1).write.mode("append").parquet(path)
    flows.use_state_store(spark)
    stream = stream_ip_rules(source(spark, path, "1 hour"), CFG, emit="eager")
    flows.run_available(stream, out + "-c", out)
    want = run_batch(enrich(events_df(spark, ev), intel(spark)), CFG).alerts.filter("rule_name != 'privilege_escalation'")
    got = spark.read.parquet(out).filter("kind = 'fired'")
    assert sorted((r.rule_name, r.event_seq) for r in got.collect()) == sorted((r.rule_name, r.trigger_seq) for r in want.collect())


def test_features_of_in_order_batches(spark, tmp_path):
    ev = sorted(random_events(23, 6, 50, 100), key=lambda e: (e["ts"], e["seq"]))
    cfg = DetectConfig(feature_window_s=7, bucket_factor=2)
    # a batch ends where the second ends, as rows of one second count for each other
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in range(0, 101, 25):
        part = [e for e in ev if lo <= e["ts"] < lo + 25]
        events_df(spark, part).coalesce(1).write.mode("append").parquet(path)
    flows.run_available(source(spark, path), out + "-c", sink=flows.stream_features(out + "-store", out, cfg))
    got = spark.read.parquet(out).drop("batch")
    want = feature_matrix(events_df(spark, ev), cfg)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_late_rows_are_kept_apart(spark, tmp_path):
    def rows(*pairs):
        return events_df(spark, [dict(seq=s, ts=t, ip="a", user="u", action="OTHER", port=None) for s, t in pairs])

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows((0, 100)), rows((1, 95), (2, 200)), rows((3, 150), (4, 195))):
        part.coalesce(1).write.mode("append").parquet(path)
    sink = flows.land(out, out + "-late", 10)
    flows.run_available(source(spark, path), out + "-c", sink=sink)
    assert sorted(r.event_seq for r in spark.read.parquet(out).collect()) == [0, 1, 2, 4]
    assert [r.event_seq for r in spark.read.parquet(out + "-late").collect()] == [3]
    # a repeated batch replaces itself
    sink(rows((3, 150), (4, 195)), 2)
    assert spark.read.parquet(out).count() == 4
