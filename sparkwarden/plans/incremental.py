"""The batch job load by load: each load goes on where the one before ended.

What the rules remember between loads is what still stands in their windows: a rule's events after the last firing of their key
and not older than its window, one table of rows per load. A firing empties its window, so nothing before it matters, and
running a rule over these rows and the new ones gives the firings of one run over everything, with the same evidence. Sources
that are blocked stay blocked. Waiting rows, windows, blocks, alerts, mitigations and notifications of a load are written
first and committed together by one row, which also holds the load's counts; a load that broke off runs again with the same
number and replaces what it left. So it also serves as the sink of a stream, with the micro-batch as load.

Events may arrive out of order by up to ``delay_s``: a load judges events up to that long before the newest one it has seen
and keeps the others waiting, so that the result is that of one load wherever the feed is cut. What comes later than that is
stored in ``late`` with its load and counted, not judged. ``finish`` judges what still waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators import alerts as rules
from sparkwarden.operators.anomaly import anomaly_alerts
from sparkwarden.operators.brute_force import failed_logins
from sparkwarden.operators.port_scan import port_events
from sparkwarden.operators.priv_escalation import login_and_sudo
from sparkwarden.operators.respond import drop_blocked, mitigations, routes_table
from sparkwarden.operators.timebuckets import SECOND_US
from sparkwarden.plans.batch import block_points
from sparkwarden.schema import ANOMALY_RULE, BRUTE_RULE, ESCALATION_RULE, ROUTES_INTENDED, SCAN_RULE
from sparkwarden.sources.loads import LoadStore
from sparkwarden.sources.tables import outbox_rows

COMMIT = (
    "high_us bigint, settled_us bigint, arrived bigint, late bigint, waiting bigint, judged bigint, dropped bigint, kept bigint, alerts bigint"
)


def _ts() -> Column:
    return F.unix_micros("event_ts")


@dataclass(frozen=True)
class _Window:
    """A rule that looks back: its key, look-back, own rows and alerts."""

    key: str
    look_back_us: int
    rows: Callable[[DataFrame], DataFrame]
    alerts: Callable[[DataFrame], DataFrame]


def _windows(cfg: DetectConfig, model: DataFrame | None) -> dict[str, _Window]:
    def of(rule):
        return lambda events: rule(events, cfg)

    found = {
        BRUTE_RULE: _Window("source_ip", cfg.brute_window_s * SECOND_US, failed_logins, of(rules.brute_force_alerts)),
        SCAN_RULE: _Window("source_ip", cfg.scan_window_s * SECOND_US, lambda e: port_events(e, cfg), of(rules.port_scan_alerts)),
        ESCALATION_RULE: _Window("user", cfg.escalation_lookback_s * SECOND_US, login_and_sudo, of(rules.escalation_alerts)),
    }
    if model is not None:  # its features look back; an alert empties nothing
        found[ANOMALY_RULE] = _Window(
            "", cfg.feature_window_s * SECOND_US, lambda e: e.where("source_ip IS NOT NULL"), lambda e: anomaly_alerts(e, model, cfg)
        )
    return found


def detect_store(spark: SparkSession, path: str) -> LoadStore:
    """Tables ``alerts, mitigations, outbox, blocks, kept, late`` by load; ``waiting`` and ``window`` are the state."""
    return LoadStore(spark, path, COMMIT)


def detect_load(
    store: LoadStore,
    events: DataFrame,
    load: int,
    cfg: DetectConfig = DEFAULT_CONFIG,
    routes=ROUTES_INTENDED,
    delay_s: int = 0,
    model: DataFrame | None = None,
    destinations: Iterable[str] = (),
    last_one: bool = False,
) -> None:
    """Judge enriched ``events`` as load number ``load``; a load that is committed already is left as it is."""
    spark, before = store.spark, store.last()
    if before is not None and before["load"] >= load:
        return
    columns = events.columns
    settled_before = None if before is None else before["settled_us"]
    is_late = F.lit(False) if settled_before is None else _ts() < settled_before
    seen = Observation()
    arrived = store.write(
        events.withColumn("_late", is_late).observe(
            seen, F.count(F.lit(1)).alias("n"), F.max(_ts()).alias("high"), F.count_if("_late").alias("late")
        ),
        "arrived",
        load,
    )
    in_time = arrived.where("NOT _late").drop("_late")
    if before is not None:
        in_time = in_time.unionByName(store.one("waiting", before["load"], in_time))
    high = max((x for x in (seen.get["high"], before and before["high_us"]) if x is not None), default=None)
    settled = settled_before if high is None else high + 1 if last_one else max(high - delay_s * SECOND_US, settled_before or high - delay_s * SECOND_US)
    now = F.lit(True) if settled is None else _ts() < settled
    store.write(arrived.where("_late").drop("_late"), "late", load)
    waits, judged = Observation(), Observation()
    store.write(in_time.where(~now).observe(waits, F.count(F.lit(1)).alias("n")), "waiting", load)

    windows = _windows(cfg, model)
    stands = None if before is None else store.one("window", before["load"])
    held = {} if stands is None else {r: stands.where(F.col("rule_name") == r).select(columns) for r in windows}
    prior = store.read("blocks")
    points = block_points(in_time.where(now), cfg, model, routes, None, held, settled_before)
    if prior is not None:
        prior = prior.drop("load")
        points = points.join(prior, "source_ip", "left_anti")
    blocks = store.write(points, "blocks", load)
    kept, _ = drop_blocked(in_time.where(now), blocks if prior is None else prior.unionByName(blocks))
    kept = store.write(kept.observe(judged, F.count(F.lit(1)).alias("n")), "kept", load)

    def with_window(rule: str) -> DataFrame:
        return kept.unionByName(held[rule]) if rule in held else kept

    cfg = cfg.with_(stored_firings=True)
    found = rules.intel_alerts(kept, cfg)
    for rule, window in _windows(cfg, model).items():
        fired = window.alerts(with_window(rule))
        if settled_before is not None:
            fired = fired.where(F.unix_micros("created_at") >= settled_before)
        found = found.unionByName(fired)
    raised = Observation()
    found = store.write(found.observe(raised, F.count(F.lit(1)).alias("n")), "alerts", load)
    store.write(mitigations(found, routes_table(spark, routes)), "mitigations", load)
    store.write(outbox_rows(found, destinations, cfg.min_severity), "outbox", load)

    store.write(_standing(found, {r: (w, with_window(r)) for r, w in windows.items()}, settled), "window", load)
    store.commit(
        load,
        high_us=high,
        settled_us=settled,
        arrived=seen.get["n"],
        late=seen.get["late"],
        waiting=waits.get["n"],
        judged=(n := in_time.where(now).count()),
        dropped=n - judged.get["n"],
        kept=judged.get["n"],
        alerts=raised.get["n"],
    )


def _standing(found: DataFrame, seen: dict[str, tuple[_Window, DataFrame]], settled: int | None) -> DataFrame:
    """The rows that stand in the windows of the rules: after the last firing of their key, and young enough for a later event."""
    out = None
    for rule, (window, events) in seen.items():
        rows = window.rows(events)
        if settled is not None:
            rows = rows.where(_ts() >= settled - window.look_back_us)
        if window.key:
            last = (
                found.where(F.col("rule_name") == rule)
                .groupBy(window.key)
                .agg(F.max(F.struct(F.unix_micros("created_at").alias("ts"), F.col("trigger_seq").alias("seq"))).alias("_last"))
            )
            after = F.struct(_ts().alias("ts"), F.col("event_seq").alias("seq")) > F.col("_last")
            rows = rows.join(last, window.key, "left").where(F.col("_last").isNull() | after).select(events.columns)
        rows = rows.withColumn("rule_name", F.lit(rule))
        out = rows if out is None else out.unionByName(rows)
    return out


def finish(store: LoadStore, **settings) -> None:
    """Judge what still waits, as a load of its own without new events."""
    last = store.last()
    if last is not None:
        none = store.one("waiting", last["load"]).limit(0)
        detect_load(store, none, last["load"] + 1, last_one=True, **settings)


def load_summary(store: LoadStore) -> DataFrame:
    """One row per load with its counts: a load's events are late, waiting or judged, and the judged ones dropped or kept."""
    done = store.commits()
    if done is None:
        return store.spark.createDataFrame([], f"load bigint, {COMMIT}")
    return done
