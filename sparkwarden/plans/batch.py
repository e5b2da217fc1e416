"""The whole batch job: enriched events in, alerts, mitigations and counts out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators import alerts as rules
from sparkwarden.operators.anomaly import anomaly_alerts, anomaly_hits
from sparkwarden.operators.brute_force import brute_force_candidates
from sparkwarden.operators.port_scan import port_scan_candidates
from sparkwarden.operators.respond import drop_blocked, first_blocks, mitigations, routes_table
from sparkwarden.operators.shared import shared_alerts
from sparkwarden.plans.materialize import materialize, shared_dir
from sparkwarden.sources.tables import read_events, write_events
from sparkwarden.schema import ANOMALY_RULE, BLOCK_PLAYBOOK, BRUTE_RULE, ESCALATION_RULE, INTEL_RULE, ROUTES_INTENDED, SCAN_RULE

Rule = Callable[[DataFrame, DetectConfig], DataFrame]

# Name of the job of the rules that share an exchange.
_TOGETHER = "windowed-rules"


def rule_set(model: DataFrame | None = None, extra: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """The rules in evaluation order, each ``(events, config) -> alerts``; without a model there is no anomaly rule.
    ``extra`` adds rules of the same form by name."""
    named: dict[str, Rule] = {
        "intel": rules.intel_alerts,
        "brute": rules.brute_force_alerts,
        "scan": rules.port_scan_alerts,
        "escalation": rules.escalation_alerts,
    }
    if model is not None:
        named["anomaly"] = lambda events, cfg: anomaly_alerts(events, model, cfg)
    named.update(extra or {})
    return named


def detect(
    events: DataFrame,
    cfg: DetectConfig = DEFAULT_CONFIG,
    model: DataFrame | None = None,
    extra: dict[str, Rule] | None = None,
) -> DataFrame:
    """Alerts of all rules over enriched events.

    The windowed rules share one exchange (:mod:`sparkwarden.operators.shared`); their firings are found when this is called. The
    others are read off the events. :func:`run_rules` runs the rules as jobs of their own, so that a failing one stops none.
    """
    named = rule_set(model, extra)
    shared = [name for name, rule in SHARED.items() if named[name] is rule.alone]
    out = shared_alerts(events, cfg, [SHARED[name].rule_name for name in shared]) if shared else None
    for name, rule in named.items():
        if name not in shared:
            found = rule(events, cfg)
            out = found if out is None else out.unionByName(found)
    return out


@dataclass(frozen=True)
class _Shared:
    rule_name: str
    alone: Rule


# Rules that detect() runs over one exchange unless ``extra`` puts another in their place.
SHARED = {
    "brute": _Shared(BRUTE_RULE, rules.brute_force_alerts),
    "scan": _Shared(SCAN_RULE, rules.port_scan_alerts),
    "escalation": _Shared(ESCALATION_RULE, rules.escalation_alerts),
}

RULE_STATUS = "job string, state string, alerts bigint, error string"


@dataclass(frozen=True)
class RuleRun:
    """Alerts of the rules that ran through, and one row per rule: ``job, state`` (done or failed), ``alerts, error``."""

    alerts: DataFrame
    status: DataFrame


def run_rules(
    events: DataFrame,
    cfg: DetectConfig = DEFAULT_CONFIG,
    model: DataFrame | None = None,
    extra: dict[str, Rule] | None = None,
    path: str | None = None,
    at_once: int = 4,
) -> RuleRun:
    """Every rule as a job of its own over ``events``, which should be a stored table: a rule that fails, in its definition or
    while it runs, leaves the alerts of the others whole.

    Jobs run ``at_once`` side by side, each in a job group named after it. Each writes its alerts to a folder of its own below
    ``path`` (one below the shared folder by default); a folder is read only if its job came to its end. The windowed rules are one
    job, as they share their exchange; if it fails, each of them is run again alone.
    """
    spark = events.sparkSession
    path = path or f"{shared_dir(spark)}/sparkwarden/rules-{uuid.uuid4().hex}"
    named = rule_set(model, extra)
    shared = [name for name, rule in SHARED.items() if named[name] is rule.alone]

    def run(job: str, rule: Rule) -> tuple[str, str | None]:
        target = f"{path}/{job}"
        spark.sparkContext.setJobGroup(target, f"rule {job}")
        try:
            rule(events, cfg).write.mode("overwrite").parquet(target)
            return target, None
        except Exception as failure:  # whatever a rule does must not reach the others
            lines = str(failure).strip().splitlines()
            return target, f"{type(failure).__name__}: {lines[0] if lines else ''}"

    def together(evs: DataFrame, config: DetectConfig) -> DataFrame:
        return shared_alerts(evs, config, [SHARED[name].rule_name for name in shared])

    def side_by_side(jobs: dict[str, Rule]) -> dict[str, tuple[str, str | None]]:
        with ThreadPoolExecutor(at_once) as pool:
            started = {job: pool.submit(inheritable_thread_target(spark)(run), job, rule) for job, rule in jobs.items()}
            return {job: future.result() for job, future in started.items()}

    jobs = {name: rule for name, rule in named.items() if name not in shared}
    ran = side_by_side({**({_TOGETHER: together} if shared else {}), **jobs})
    windowed = ran.pop(_TOGETHER, None)
    if windowed is not None and windowed[1] is not None:
        ran.update(side_by_side({name: named[name] for name in shared}))
        windowed = None

    found = {job: spark.read.parquet(target) for job, (target, error) in ran.items() if error is None}
    if windowed is not None:
        every = spark.read.parquet(windowed[0])
        found.update({name: every.where(F.col("rule_name") == SHARED[name].rule_name) for name in shared})
    status = spark.createDataFrame([(job, "failed", 0, error) for job, (_, error) in ran.items() if error is not None], RULE_STATUS)
    for job, rows in found.items():
        status = status.unionByName(
            rows.agg(F.count(F.lit(1)).alias("alerts")).select(
                F.lit(job).alias("job"), F.lit("done").alias("state"), "alerts", F.lit(None).cast("string").alias("error")
            )
        )
    alerts = None
    for rows in found.values():
        alerts = rows if alerts is None else alerts.unionByName(rows)
    return RuleRun(rules.intel_alerts(events.where("false"), cfg) if alerts is None else alerts, status)


def block_points(
    events: DataFrame,
    cfg: DetectConfig = DEFAULT_CONFIG,
    model: DataFrame | None = None,
    routes=ROUTES_INTENDED,
    prior: DataFrame | None = None,
    before: dict[str, DataFrame] | None = None,
    since_us: int | None = None,
) -> DataFrame:
    """First block of each source over unfiltered events, ``source_ip, block_ts, block_seq``.

    A source's first block depends on its own earlier events only, and the first firing of a windowed rule is its
    first candidate, so no re-arming is needed here. ``prior`` holds blocks from before (same columns); ``before`` the
    earlier events that still stand in a rule's window, by rule. These, all before ``since_us``, block nothing themselves.
    """
    blocking = {rule for rule, playbook in routes if playbook == BLOCK_PLAYBOOK}
    points = [] if prior is None else [prior.select("source_ip", "block_ts", "block_seq")]

    def add(df, key, ts, seq):
        new = df if since_us is None else df.where(ts >= since_us)
        points.append(new.select(key.alias("source_ip"), ts.alias("block_ts"), seq.alias("block_seq")))

    def seen(rule):
        return events if before is None or rule not in before else events.unionByName(before[rule])

    by_event = (F.col("source_ip"), F.unix_micros("event_ts"), F.col("event_seq"))
    by_key = (F.col("key"), F.col("ts_us"), F.col("event_seq"))
    if INTEL_RULE in blocking:
        add(rules.intel_hits(events, cfg), *by_event)
    if BRUTE_RULE in blocking:
        add(brute_force_candidates(seen(BRUTE_RULE), cfg), *by_key)
    if SCAN_RULE in blocking:
        add(port_scan_candidates(seen(SCAN_RULE), cfg), *by_key)
    if ANOMALY_RULE in blocking and model is not None:
        add(anomaly_hits(seen(ANOMALY_RULE), model, cfg, ("source_ip", "event_ts")), *by_event)
    if not points:
        empty = events.select("source_ip", F.unix_micros("event_ts").alias("block_ts"), F.col("event_seq").alias("block_seq"))
        return empty.filter("false")
    out = points[0]
    for p in points[1:]:
        out = out.unionByName(p)
    return first_blocks(out)


@dataclass(frozen=True)
class BatchResult:
    kept: DataFrame
    dropped: DataFrame
    alerts: DataFrame
    mitigations: DataFrame
    blocks: DataFrame


def run_batch(
    events: DataFrame,
    cfg: DetectConfig = DEFAULT_CONFIG,
    model: DataFrame | None = None,
    routes=ROUTES_INTENDED,
    prior: DataFrame | None = None,
    extra: dict[str, Rule] | None = None,
    events_path: str | None = None,
) -> BatchResult:
    """Exact block feedback in two passes over enriched events.

    Pass 1 finds each source's first block; its later events are dropped; pass 2 runs every rule on the rest. Blocks
    and alerts are written once to the shared folder, as several branches read them. With ``events_path`` the kept
    events are appended to that event store first and the rules read them from there, so that parsing, enrichment and
    the drop are not repeated for each rule, and evidence is shuffled only where a rule fired; the path must be new to
    this run.
    """
    blocks = materialize(block_points(events, cfg, model, routes, prior))
    kept, dropped = drop_blocked(events, blocks)
    if events_path is not None:
        write_events(kept, events_path)
        kept = read_events(events.sparkSession, events_path).select(*events.columns)
    found = materialize(detect(kept, cfg, model, extra))
    return BatchResult(kept, dropped, found, mitigations(found, routes_table(events.sparkSession, routes)), blocks)
