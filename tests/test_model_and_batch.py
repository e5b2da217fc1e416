"""Features, forest, the two-pass batch job, and invariance under partitioning."""

from pyspark.sql import functions as F

from sparkwarden.config import DetectConfig
from sparkwarden.operators import iforest
from sparkwarden.operators.anomaly import anomaly_alerts
from sparkwarden.operators.enrich import enrich
from sparkwarden.operators.features import feature_matrix, window_features
from sparkwarden.operators.respond import drop_blocked
from sparkwarden.plans.batch import detect, run_batch
from sparkwarden.schema import FEATURE_NAMES, ROUTES_AS_CODED
from tests import naive
from tests.helpers import events_df, random_events


def test_window_features(spark):
    ev = random_events(5, 30, 60, 80, ports=5)
    for factor, w in [(2, 6), (16, 6), (2, 1)]:
        cfg = DetectConfig(feature_window_s=w, bucket_factor=factor)
        got = {r.event_seq: (r.velocity, r.distinct_ports) for r in window_features(events_df(spark, ev), cfg).collect()}
        assert got == naive.features(ev, w)


def test_clock_features(spark):
    df = spark.sql(
        "SELECT bigint(i) AS event_seq, t AS event_ts, CAST(t AS timestamp_ntz) AS event_wall, 'a' AS source_ip, 'SUDO_COMMAND' AS action, "
        "bigint(null) AS destination_port FROM VALUES (0, timestamp'2023-11-15 14:30:00'), (1, timestamp'2023-11-18 03:15:00') v(i, t)"
    )
    got = {r.event_seq: (r.hour_of_day, r.is_weekend, r.is_sudo) for r in feature_matrix(df).collect()}
    assert got == {0: (14, 0, 1), 1: (3, 1, 1)}


def planted(spark, n=3000):
    """Plain daytime traffic and 20 busy night rows."""
    odd = F.col("id") >= n
    return spark.range(n + 20).select(
        F.col("id").alias("event_seq"),
        F.when(odd, 3).otherwise(9 + F.col("id") % 8).cast("int").alias("hour_of_day"),
        F.when(odd, 1).otherwise(0).alias("is_weekend"),
        F.when(odd, 1).otherwise(0).alias("is_failed_login"),
        F.lit(0).alias("is_sudo"),
        F.when(odd, 60 + F.col("id") % 7).otherwise(1 + F.col("id") % 5).alias("velocity_60s"),
        F.when(odd, 30).otherwise(1 + F.col("id") % 3).alias("unique_ports_60s"),
    )


def test_forest_finds_planted_outliers_whatever_the_partitions(spark):
    df = planted(spark)
    models = []
    for parts in (1, 7):
        shuffled = df.repartition(parts, F.rand(parts))
        models.append(iforest.fit_model(shuffled))
    nodes = [sorted(map(tuple, m.collect())) for m in models]
    assert nodes[0] == nodes[1]
    flagged = iforest.predict(df, models[0]).filter("is_outlier").select("event_seq").collect()
    seqs = {r.event_seq for r in flagged}
    assert set(range(3000, 3020)) <= seqs and len(seqs) <= 0.05 * 3020


def test_tree_samples(spark):
    for rows, sample in [(3000, 256), (1000, 256), (100, 100)]:
        got = iforest.tree_samples(planted(spark, rows - 20), trees=20).groupBy("tree_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d")
        ).collect()
        assert len(got) == 20 and {(r.n, r.d) for r in got} == {(sample, sample)}


def test_cold_start_and_alerts(spark):
    base = iforest.cold_start(spark, "2024-01-03")
    assert base.count() == 100 and base.filter("action = 'ACCEPTED_LOGIN'").count() == 10
    assert {r[0] for r in base.select(F.hour("event_wall")).distinct().collect()} == set(range(9, 17))
    ev = random_events(8, 6, 60, 50)
    events = events_df(spark, ev)
    model = iforest.fit_model(feature_matrix(events), trees=20)
    for a in anomaly_alerts(events, model).collect():
        assert a.severity == "high" and a.evidence_count == 1 and a.metadata.model == "IsolationForest"
    assert detect(enrich(events, intel(spark))).filter("rule_name = 'ml_behavioral_anomaly'").count() == 0


def intel(spark):
    return spark.createDataFrame([("10.0.9.3", 90, ["X"]), ("10.0.9.4", 79, [])], "ip string, reputation_score int, tags array<string>")


def sequential(ev, cfg, blocking):
    """The live order of work: drop if blocked, run every rule, block."""
    blocked, kept, fired = set(), [], []
    for e in naive.ordered(ev):
        if e["ip"] in blocked:
            continue
        kept.append(e)
        now = []
        if e["ip"] == "10.0.9.3":
            now.append(("threat_intel_match", e["seq"]))
        mine = [x for x in kept if x["ip"] == e["ip"]]
        theirs = [x for x in kept if x["user"] == e["user"]]
        for rule, found in (
            ("brute_force_ssh", naive.brute_force(mine, cfg.brute_threshold, cfg.brute_window_s)),
            ("port_scan", naive.port_scan(mine, cfg.scan_threshold, cfg.scan_window_s)),
            ("privilege_escalation", naive.escalation(theirs, cfg.escalation_min_failures, cfg.escalation_lookback_s)),
        ):
            now += [(rule, s) for _, s, _ in found if s == e["seq"]]
        fired += now
        if e["ip"] is not None and any(rule in blocking for rule, _ in now):
            blocked.add(e["ip"])
    return sorted(fired), sorted(e["seq"] for e in kept)


CFG = DetectConfig(
    brute_threshold=3, brute_window_s=6, scan_threshold=4, scan_window_s=8, escalation_lookback_s=20, bucket_factor=2
)


def test_two_pass_batch_equals_live_order(spark, tmp_path):
    ev = random_events(9, 12, 60, 120)
    events = enrich(events_df(spark, ev), intel(spark))
    for path in (None, str(tmp_path / "events")):
        got = run_batch(events, CFG, events_path=path)
        alerts = sorted((r.rule_name, r.trigger_seq) for r in got.alerts.collect())
        want = sequential(ev, CFG, {"threat_intel_match", "brute_force_ssh", "port_scan", "ml_behavioral_anomaly"})
        assert (alerts, sorted(r.event_seq for r in got.kept.collect())) == want
    coded = run_batch(events, CFG, routes=ROUTES_AS_CODED)
    assert sorted((r.rule_name, r.trigger_seq) for r in coded.alerts.collect()) == sequential(ev, CFG, set())[0]
    assert coded.dropped.count() == 0


def test_prior_block_and_order(spark):
    ev = [dict(seq=i, ts=t, ip=ip, user="u", action="OTHER", port=None) for i, t, ip in [(0, 1, "a"), (1, 2, "a"), (2, 2, "a"), (3, 9, None)]]
    df = events_df(spark, ev)
    t2 = df.filter("event_seq = 1").select(F.unix_micros("event_ts")).first()[0]
    blocks = spark.createDataFrame([("a", t2, 1)], "source_ip string, block_ts bigint, block_seq bigint")
    kept, dropped = drop_blocked(df, blocks)
    assert sorted(r.event_seq for r in kept.collect()) == [0, 1, 3]
    assert [r.event_seq for r in dropped.collect()] == [2]


def test_partition_invariance(spark):
    events = enrich(events_df(spark, random_events(10, 10, 80, 150)), intel(spark))
    seen = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = detect(events.repartition(int(n)), CFG).selectExpr("alert_id", "evidence_count", "description").collect()
        seen.append(sorted(map(str, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] and seen[0]
    assert FEATURE_NAMES[0] == "hour_of_day"
