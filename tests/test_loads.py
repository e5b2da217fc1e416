"""Landing with lasting numbers, the incremental job against one run, and raw text streams that end in alerts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.config import DetectConfig
from sparkwarden.operators.alerts import brute_force_alerts
from sparkwarden.operators.enrich import enrich
from sparkwarden.operators.iforest import fit_model
from sparkwarden.operators.features import feature_matrix
from sparkwarden.plans import load_catalog
from sparkwarden.plans.batch import run_batch
from sparkwarden.plans.incremental import detect_load, detect_store, finish, load_summary
from sparkwarden.schema import ROUTES_AS_CODED, ROUTES_INTENDED
from sparkwarden.sources import landing
from sparkwarden.streaming import flows
from sparkwarden.streaming.alerts import feed_sink, stream_texts
from tests.helpers import events_df, random_events

INTEL = "ip string, reputation_score int, tags array<string>"


def put(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as out:
        out.writelines(f"{x}\n" for x in lines)


def failures(day, n=6, host="web"):
    return [f"Jan {day:2d} 10:00:{k:02d} {host} sshd[{k}]: Failed password for bob from 10.9.8.7 port {4000 + k} ssh2" for k in range(n)]


def numbers(store):
    return {(os.path.basename(r.file), r.value): r.event_seq for r in landing.read_landed(store).collect()}


def test_days_land_once_and_keep_their_numbers(spark, tmp_path):
    feed, store = str(tmp_path / "feed"), landing.landing_store(spark, str(tmp_path / "landed"))
    alerts = set()
    for day in (1, 2, 3):
        put(feed, f"day{day}.log", ["not a line", *failures(day)])
        done = landing.land(store, feed)
        assert (done.load, done.n_files, done.changed) == (day - 1, 1, 0)
        assert landing.land(store, feed) == landing.Landed(None, 0, 0)
        events, rejects = landing.landed_events(landing.read_landed(store), 2024)
        assert rejects.count() == day
        found = {r.alert_id for r in brute_force_alerts(events).collect()}
        assert alerts < found and len(found) == day
        alerts = found
    before = numbers(store)
    assert sorted(before.values()) == list(range(21))
    assert [before[f"day{d}.log", x] for d in (1, 2, 3) for x in ["not a line", *failures(d)]] == list(range(21))
    put(feed, "day0.log", failures(9, 3))
    put(feed, "empty.log", [])
    assert landing.land(store, feed).n_files == 1  # an empty file has nothing to land
    after = numbers(store)
    assert {k: after[k] for k in before} == before and len(after) == 24
    put(feed, "day1.log", ["changed afterwards"])
    assert landing.land(store, feed) == landing.Landed(None, 0, 1)
    assert numbers(store) == after


def test_blocks_of_a_file_are_numbered_in_order(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 37) for k in range(5000)]
    put(str(tmp_path / "feed"), "a.log", lines[:4000])
    put(str(tmp_path / "feed"), "b.log", lines[4000:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        store = landing.landing_store(spark, str(tmp_path / "landed"))
        landing.land(store, str(tmp_path / "feed"))
        assert store.read("blocks").count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in landing.read_landed(store).orderBy("event_seq").collect()] == lines


def test_a_load_that_broke_off_is_repeated(spark, tmp_path):
    feed, store = str(tmp_path / "feed"), landing.landing_store(spark, str(tmp_path / "landed"))
    put(feed, "a.log", ["one", "two"])
    landing.land(store, feed)
    # a second load wrote its rows and went no further
    store.write(store.one("rows", 0), "rows", 1)
    assert landing.read_landed(store).count() == 2
    put(feed, "b.log", ["three"])
    landing.land(store, feed)
    assert numbers(store) == {("a.log", "one"): 0, ("a.log", "two"): 1, ("b.log", "three"): 2}


def test_envelopes_land_entry_by_entry(spark, tmp_path):
    feed, store = str(tmp_path / "feed"), landing.landing_store(spark, str(tmp_path / "landed"))
    put(feed, "a.json", ['{"events": [{"action": "x"}, {"action": 3}], "logs": ["l1", "l2"]}', "broken", "{}", '{"logs": 5}', '{"logs": ["l3"]}'])
    landing.land(store, feed, landing.bulk_entries)
    rows = [(r.event_seq, r.kind, r.value, r.reject_reason) for r in landing.read_landed(store).orderBy("event_seq").collect()]
    assert rows == [
        (0, "line", "l1", None), (1, "line", "l2", None), (2, "entry", '{"action":"x"}', None), (3, "entry", '{"action":3}', None),
        (4, "reject", "broken", "bad_json"), (5, "reject", '{"logs": 5}', "bad_field"), (6, "line", "l3", None),
    ]
    events, rejects = landing.landed_events(landing.read_landed(store), 2024, ("line", "entry"))
    assert [(r.event_seq, r.action) for r in events.collect()] == [(2, "X")]
    assert {(r.event_seq, r.reject_reason) for r in rejects.collect()} == {
        (0, "no_header"), (1, "no_header"), (6, "no_header"), (3, "bad_field"), (4, "bad_json"), (5, "bad_field"),
    }


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(9)}", k, rng.randrange(5)) for k in range(500)]
    got = landing.running_totals(spark.createDataFrame(rows, "file string, block bigint, n bigint"), ["file", "block"], "n").collect()
    total, want = 0, {}
    for f, b, n in sorted(rows):
        want[f, b] = total
        total += n
    assert {(r.file, r.block): r.before for r in got} == want


def view(alerts):
    return {(r.alert_id, r.evidence_count, r.description, tuple(e.event_seq for e in r.evidence)) for r in alerts.collect()}


@pytest.mark.parametrize(
    "seed, cfg, routes",
    [
        (1, DetectConfig(brute_threshold=3, brute_window_s=10, scan_threshold=3, scan_window_s=8, escalation_lookback_s=12), ROUTES_AS_CODED),
        (2, DetectConfig(brute_threshold=4, brute_window_s=20, scan_threshold=6, scan_window_s=9, escalation_lookback_s=15, escalation_min_failures=2), ROUTES_INTENDED),
    ],
)
def test_loads_equal_one_run_wherever_the_feed_is_cut(spark, tmp_path, seed, cfg, routes):
    rng, delay = random.Random(seed), 5
    events = random_events(seed, 12, 60, 150, ports=9)
    arrival = sorted(events, key=lambda e: (e["ts"] + rng.random() * delay, e["seq"]))
    cuts = sorted(rng.sample(range(len(arrival)), 2))
    parts = [arrival[a:b] for a, b in zip([0, *cuts], [*cuts, len(arrival)], strict=True)]
    intel = spark.createDataFrame([("10.0.%d.3" % seed, 90, ["x"])], INTEL)
    one = run_batch(enrich(events_df(spark, events), intel), cfg, routes=routes)
    store = detect_store(spark, str(tmp_path / "detect"))
    for n, part in enumerate(parts):
        detect_load(store, enrich(events_df(spark, part), intel), n, cfg, routes, delay)
        detect_load(store, enrich(events_df(spark, part), intel), n, cfg, routes, delay)
    finish(store, cfg=cfg, routes=routes, delay_s=delay)
    want = view(one.alerts)
    assert view(store.read("alerts")) == want and len(want) > 5
    assert {r.triggering_alert_id for r in store.read("mitigations").collect()} == {r.triggering_alert_id for r in one.mitigations.collect()}
    assert {(r.source_ip, r.block_seq) for r in store.read("blocks").collect()} == {(r.source_ip, r.block_seq) for r in one.blocks.collect()}
    sums = load_summary(store).agg(*[F.sum(c).alias(c) for c in ("arrived", "late", "judged", "dropped", "kept", "alerts")]).first()
    assert (sums.arrived, sums.late, sums.judged, sums.alerts) == (len(events), 0, len(events), len(want))
    assert sums.dropped == one.dropped.count() and sums.kept == one.kept.count() == store.read("kept").count()


def test_late_events_are_kept_apart_and_outliers_are_found_online(spark, tmp_path):
    cfg = DetectConfig(brute_threshold=99, scan_threshold=99, feature_window_s=20, bucket_factor=2)
    events = random_events(5, 6, 60, 100, ports=5)
    df = enrich(events_df(spark, events), spark.createDataFrame([], INTEL))
    model = fit_model(feature_matrix(df.where("source_ip IS NOT NULL"), cfg), trees=10)
    want = {r.alert_id for r in run_batch(df, cfg, model, ROUTES_INTENDED).alerts.collect()}
    store = detect_store(spark, str(tmp_path / "detect"))
    middle = F.timestamp_seconds(F.lit(1_700_000_000 + 50))
    settings = {"cfg": cfg, "model": model}
    detect_load(store, df.where(F.col("event_ts") < middle), 0, **settings)
    detect_load(store, df.where(F.col("event_ts") >= middle), 1, **settings)
    detect_load(store, df.orderBy("event_ts").limit(3), 2, **settings)  # far behind
    finish(store, **settings)
    assert {r.alert_id for r in store.read("alerts").collect()} == want and want
    assert store.read("late").count() == 3
    assert [r.late for r in load_summary(store).orderBy("load").collect()] == [0, 0, 3, 0]


def test_a_stream_of_raw_lines_ends_in_alerts(spark, tmp_path):
    feed, path = str(tmp_path / "feed"), str(tmp_path / "out")
    intel = lambda s: s.createDataFrame([], INTEL)
    sink = feed_sink(path, intel, year=2024, destinations=("pager",))
    store = detect_store(spark, path)
    # the window reaches over two micro-batches; a blocked source raises no second alert
    for name, lines in (("a.log", failures(1)[:3]), ("b.log", [*failures(1)[3:], "noise"]), ("c.log", failures(2))):
        put(feed, name, lines)
        flows.run_available(stream_texts(spark, feed), f"{path}/checkpoint", sink=sink)
    finish(store, destinations=("pager",))
    alerts = store.read("alerts").collect()
    assert [(r.rule_name, r.trigger_seq, r.evidence_count) for r in alerts] == [("brute_force_ssh", 4, 5)]
    assert [(r.action, r.target) for r in store.read("mitigations").collect()] == [("BLOCK_IP", "10.9.8.7")]
    assert store.read("outbox").count() == 1
    assert spark.read.parquet(f"{path}/rejects").count() == 1
    done = {r.load: (r.arrived, r.dropped, r.alerts) for r in load_summary(store).collect()}
    assert sum(d[0] for d in done.values()) == 12 and sum(d[1] for d in done.values()) == 7
    # a micro-batch that runs again changes nothing
    sink(landing.with_origin(spark.read.text(feed)), 1)
    assert store.read("alerts").count() == 1


def test_the_streamed_feed_comes_in_many_files_and_two_batches(spark, sf_dir, monkeypatch):
    """A delivery is read by many tasks, yet judged as one micro-batch, so that none of its events is late."""
    paths, read = [], load_catalog.readers.stream_events
    monkeypatch.setattr(load_catalog.readers, "stream_events", lambda s, path, *a, **k: paths.append(path) or read(s, path, *a, **k))
    monkeypatch.setattr(load_catalog, "_FILE_ROWS", 4, raising=False)
    store = load_catalog.streamed_store(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    files = len(spark.read.parquet(paths[0]).inputFiles())
    assert files >= rows / 4 and files > 200
    batches = [(r.load, r.late) for r in load_summary(store).orderBy("load").collect() if r.arrived]
    assert batches == [(0, 0), (1, 0)]
