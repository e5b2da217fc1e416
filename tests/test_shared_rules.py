"""The windowed rules over one exchange: equal to the sequential restatement and to each rule alone, and the plan."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwarden.config import DetectConfig
from sparkwarden.operators import alerts as rules
from sparkwarden.operators import shared
from sparkwarden.operators.enrich import enrich, sample_intel
from sparkwarden.operators.joins import salted_join
from sparkwarden.operators.rearm import _grouped
from sparkwarden.operators.shared import WINDOWED, _candidate_rows, shared_alerts, shared_evidence, shared_firings
from sparkwarden.plans import batch
from sparkwarden.plans import catalog as c
from sparkwarden.schema import BRUTE_RULE, ESCALATION_RULE, SCAN_RULE
from sparkwarden.sources.adapter import sec_events
from tests import naive
from tests.helpers import events_df, random_events
from tests.test_rules_random import SHAPES


@pytest.mark.parametrize("seed,keys,per_key,span", SHAPES)
@pytest.mark.parametrize("factor,t,w,n,sw,m,ew", [(2, 3, 5, 4, 6, 1, 2), (2, 1, 4, 6, 12, 2, 6), (16, 3, 5, 2, 3, 3, 9), (3, 5, 7, 4, 6, 1, 8)])
def test_firings_equal_the_sequential_rules(spark, seed, keys, per_key, span, factor, t, w, n, sw, m, ew):
    ev = random_events(seed, keys, per_key, span, ports=9)
    cfg = DetectConfig(
        brute_threshold=t, brute_window_s=w, scan_threshold=n, scan_window_s=sw, escalation_min_failures=m,
        escalation_lookback_s=ew, bucket_factor=factor,
    )
    want = {(BRUTE_RULE, k, s) for k, s, _ in naive.brute_force(ev, t, w)}
    want |= {(SCAN_RULE, k, s) for k, s, _ in naive.port_scan(ev, n, sw)}
    want |= {(ESCALATION_RULE, k, s) for k, s, _ in naive.escalation(ev, m, ew)}
    got = [(r.rule_name, r.key, r.event_seq) for r in shared_firings(events_df(spark, ev), cfg).collect()]
    assert want and len(got) == len(want) and set(got) == want


def shown(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("cap", [None, 2, 0])
def test_alerts_equal_each_rule_alone(spark, cap):
    ev = events_df(spark, random_events(4, 25, 200, 150, ports=9))
    cfg = DetectConfig(
        brute_threshold=3, brute_window_s=5, scan_threshold=4, scan_window_s=6, escalation_lookback_s=8, bucket_factor=3, evidence_cap=cap
    )
    alone = rules.brute_force_alerts(ev, cfg).unionByName(rules.port_scan_alerts(ev, cfg)).unionByName(rules.escalation_alerts(ev, cfg))
    together = shared_alerts(ev, cfg)
    assert together.schema.simpleString() == alone.schema.simpleString()
    assert shown(together) == shown(alone) != []


def test_one_rule_and_no_rows(spark):
    ev = events_df(spark, random_events(4, 5, 60, 50))
    cfg = DetectConfig(brute_threshold=3, brute_window_s=5)
    assert shown(shared_alerts(ev, cfg, (BRUTE_RULE,))) == shown(rules.brute_force_alerts(ev, cfg)) != []
    assert shared_alerts(ev.where("false"), cfg).count() == 0


def test_a_busy_source_with_few_ports_sends_nothing_to_python(spark):
    rows = [
        dict(seq=i, ts=i // 4, ip="10.0.0.1", user=None, action="CONNECTION", port=i % 9 if i < 4000 else i % 12) for i in range(6000)
    ]
    cfg = DetectConfig(scan_threshold=10, scan_window_s=30)
    few = events_df(spark, [r for r in rows if r["seq"] < 4000])
    assert _candidate_rows(few, cfg, (SCAN_RULE,)).count() == 0
    assert shared_firings(few, cfg).count() == 0
    assert sorted(r.event_seq for r in shared_firings(events_df(spark, rows), cfg).collect()) == [
        s for _, s, _ in naive.port_scan(rows, 10, 30)
    ]


def test_rows_of_all_rules_are_shuffled_once(spark, sf_dir):
    rows = _candidate_rows(sec_events(spark, sf_dir), c.CFG, WINDOWED)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("events.parquet") == 1 and "value:double" not in plan
    fired = shared_firings(sec_events(spark, sf_dir), c.CFG)
    fired.collect()
    plan = fired._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "events.parquet" not in plan and "ReusedExchange" in plan and "Cartesian" not in plan


def test_detect_shuffles_events_of_hit_buckets_only(spark, sf_dir):
    df = batch.detect(c.enriched(spark, sf_dir), c.CFG)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") <= 2  # firings are stored before: evidence and reputation are left
    assert plan.count("REPARTITION_BY_COL") == 1 and "LeftSemi" in plan


@pytest.fixture
def stored(spark, tmp_path):
    events_df(spark, random_events(4, 25, 100, 150, ports=9)).write.parquet(str(tmp_path / "events"))
    return enrich(spark.read.parquet(str(tmp_path / "events")), sample_intel(spark))


RUN_CFG = DetectConfig(brute_threshold=3, brute_window_s=5, scan_threshold=4, scan_window_s=6, escalation_lookback_s=8)


def status(run):
    return {r.job: (r.state, r.alerts) for r in run.status.collect()}


def test_a_failing_rule_leaves_the_others(spark, stored, tmp_path):
    def fails_when_defined(events, cfg):
        raise ValueError("no such column")

    def fails_when_run(events, cfg):
        from pyspark.sql import functions as F

        return rules.brute_force_alerts(events, cfg).withColumn("context", F.raise_error(F.lit("bad row")).cast("string"))

    run = batch.run_rules(
        stored, RUN_CFG, extra={"first": fails_when_defined, "second": fails_when_run}, path=str(tmp_path / "rules")
    )
    assert shown(run.alerts) == shown(batch.detect(stored, RUN_CFG)) != []
    got = status(run)
    assert {j for j, (s, _) in got.items() if s == "failed"} == {"first", "second"}
    assert {j for j, (s, _) in got.items() if s == "done"} == {"intel", "brute", "scan", "escalation"}
    assert sum(n for _, n in got.values()) == run.alerts.count()
    errors = {r.job: r.error for r in run.status.collect()}
    assert errors["first"] == "ValueError: no such column" and errors["second"] and errors["brute"] is None


def test_windowed_rules_run_alone_if_their_common_job_fails(spark, stored, monkeypatch):
    want = shown(batch.detect(stored, RUN_CFG))

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(batch, "shared_alerts", broken)
    run = batch.run_rules(stored, RUN_CFG)
    assert shown(run.alerts) == want and all(s == "done" for s, _ in status(run).values())


def test_all_rules_may_fail(spark, stored):
    def broken(events, cfg):
        raise RuntimeError("lost")

    run = batch.run_rules(stored, RUN_CFG, extra=dict.fromkeys(("intel", "brute", "scan", "escalation"), broken))
    assert run.alerts.count() == 0 and {s for s, _ in status(run).values()} == {"failed"}


def test_tasks_follow_the_feed(spark, monkeypatch):
    """The exchanges are dealt by the number of events, so that no task sorts a share that grows with the feed."""
    ev = events_df(spark, random_events(4, 25, 200, 150, ports=9))
    cfg = DetectConfig(brute_threshold=3, brute_window_s=5, scan_threshold=4, scan_window_s=6, escalation_lookback_s=8, bucket_factor=3)
    want = shown(shared_alerts(ev, cfg))
    assert shared.task_count(ev) is None
    monkeypatch.setattr(shared, "EVENTS_A_TASK", ev.count() // 30)
    tasks = shared.task_count(ev)
    assert tasks > 30
    assert _candidate_rows(ev, cfg, WINDOWED, tasks).rdd.getNumPartitions() == tasks
    fired = shared_firings(ev, cfg, WINDOWED, tasks)
    assert fired.rdd.getNumPartitions() == tasks
    assert shared.shared_evidence(ev, fired, cfg, WINDOWED, tasks).rdd.getNumPartitions() == tasks
    assert shown(shared_alerts(ev, cfg)) == want != []


def test_the_folds_read_candidates_only(spark, monkeypatch):
    """The port fold runs once: what is stored for the two folds are candidates, not all rows of a burst."""
    rows = [dict(seq=i, ts=i // 2, ip="10.0.0.1", user=None, action="CONNECTION", port=i % 4 if i < 900 else i) for i in range(1000)]
    stored, store = [], shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df: stored.append(store(df)) or stored[-1])
    cfg = DetectConfig(scan_threshold=10, scan_window_s=30)
    fired = shared_firings(events_df(spark, rows), cfg, (SCAN_RULE,)).count()
    # the first tenth port comes at 905
    assert fired == len(naive.port_scan(rows, 10, 30)) > 0 and stored[0].where(f"zone = {shared._OWN}").count() == 95


def test_folds_read_the_strings_of_a_group_once():
    """Rows with their group in front are those of the columns, over batches, nulls and groups that go on in the next batch."""
    columns = {
        "key": ["a", "a", "a", "b", None, None, "b", "b"], "bucket": [1, 1, 2, 2, 2, 2, None, 3],
        "ts_us": [1, 2, 3, 4, 5, 6, 7, 8], "port": [None, 5, 5, 6, 7, None, 9, 2], "is_halo": [True, False] * 4,
    }
    whole = pa.record_batch(columns)
    batches = [whole.slice(0, 2), whole.slice(2, 0), whole.slice(2, 1), whole.slice(3, 5)]
    got = [*_grouped(batches, ("key", "bucket"), ("ts_us", "port", "is_halo"))]
    assert got == [((k, b), *rest) for k, b, *rest in zip(*columns.values())]
    assert got[0][0] is got[1][0] and all(type(row[1]) is int for row in got)


def test_evidence_carries_the_message_for_escalations_only(spark):
    ev = events_df(spark, random_events(4, 25, 200, 150, ports=9)).withColumn("message", F.lit("text"))
    cfg = DetectConfig(brute_threshold=3, brute_window_s=5, scan_threshold=4, scan_window_s=6, escalation_lookback_s=8, bucket_factor=3)
    flat = shared_evidence(ev, shared_firings(ev, cfg).cache(), cfg)
    told = {r.rule_name: r.told for r in flat.groupBy("rule_name").agg(F.count("message").alias("told")).collect()}
    assert set(told) == set(WINDOWED) and [rule for rule, n in told.items() if n] == [ESCALATION_RULE]


def test_no_task_count_beyond_what_writers_pass_on(spark, monkeypatch):
    """Spark's writers hold rows in memory beyond 200 partitions (spark.shuffle.sort.bypassMergeThreshold), as many as a task reads."""
    ev = events_df(spark, random_events(4, 25, 200, 150, ports=9))
    monkeypatch.setattr(shared, "EVENTS_A_TASK", ev.count() // 1000)
    assert shared.task_count(ev) == 200


def test_rows_repeated_for_salts_are_not_broadcast(spark):
    """Whatever size Spark guesses for a lookup table, its 32 copies are dealt out, and the rows are those of the plain join."""
    facts = events_df(spark, random_events(5, 6, 20, 50))
    dim = facts.select("source_ip").distinct().where("source_ip IS NOT NULL").withColumn("score", F.length("source_ip"))
    got = salted_join(facts.select("event_seq", "source_ip"), dim, "source_ip")
    want = facts.select("event_seq", "source_ip").join(dim, "source_ip", "left")
    assert shown(got) == shown(want.select(*got.columns)) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
