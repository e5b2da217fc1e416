"""All windowed rules over one exchange: the narrow rows of brute force, port scan and escalation travel together.

Each event gives one narrow row per rule that looks at it, keyed by ``(rule, key, bucket)`` with the rule's own window and bucket
width. Rows of the three windows before a bucket are copied into it: the last two hold the candidates that warm up the re-arming,
the first one what those candidates look back at. So the candidates of all rules come from this one exchange. A port scan's are
found in Python, once. Candidates are stored, as two folds read them: one gives the handover maps, the other the firings.

Before Python sees a row, window functions have decided most: brute-force and escalation candidates are whole, and of the port
scan's rows only bursts (no gap above the window) that hold enough distinct ports are left.

Evidence takes one more exchange, of the events in buckets where a rule fired. A firing and its window lie in one bucket or in the
copied rows before it, so the window's events are gathered where they were sorted.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators import alerts as rules
from sparkwarden.operators.evidence import EVIDENCE_FIELDS
from sparkwarden.operators.joins import BROADCAST_ROWS
from sparkwarden.operators.rearm import _ENTRY, _HALO, _NONE, _OWN, _emit, _grouped, _rows, chain_rows, handover_rows
from sparkwarden.operators.timebuckets import SECOND_US
from sparkwarden.plans.materialize import materialize
from sparkwarden.schema import BRUTE_RULE, ESCALATION_RULE, SCAN_RULE

WINDOWED = (BRUTE_RULE, SCAN_RULE, ESCALATION_RULE)

# Events whose narrow rows one task sorts; some 3 rows an event and three sorts at once take about 1.5 kB an event.
EVENTS_A_TASK = 100_000
# Up to so many partitions Spark's writers pass each row on to a file; beyond (spark.shuffle.sort.bypassMergeThreshold) they hold
# the rows of the file they read in memory, which for a few large files is far more than what a task sorts.
MOST_TASKS = 200

# Zone of a row that only candidates look back at; it comes before all others.
_BEFORE = -1
# The key first: sorts compare by it, and most rows differ there.
_GROUP = ("key", "rule_name", "bucket")
_FOLD_COLS = (*_GROUP, "zone", "ts_us", "event_seq", "q_ts", "q_seq", "port")


def _schema(**fields):
    types = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([pa.field(n, types[t]) for n, t in fields.items()]), ", ".join(f"{n} {t}" for n, t in fields.items())


_MAP_ARROW, _MAP_DDL = _schema(
    rule_name="string", key="string", bucket="bigint", in_ts="bigint", in_seq="bigint", out_ts="bigint", out_seq="bigint"
)
_CANDIDATE_ARROW, _CANDIDATE_DDL = _schema(
    rule_name="string", key="string", bucket="bigint", zone="bigint", ts_us="bigint", event_seq="bigint", q_ts="bigint", q_seq="bigint"
)
_STATE_ARROW, _STATE_DDL = _schema(rule_name="string", key="string", bucket="bigint", last_ts="bigint", last_seq="bigint")
_FIRED_ARROW, _FIRED_DDL = _schema(rule_name="string", key="string", ts_us="bigint", event_seq="bigint")


def _windows_us(cfg: DetectConfig) -> dict[str, int]:
    return {
        BRUTE_RULE: cfg.brute_window_s * SECOND_US,
        SCAN_RULE: cfg.scan_window_s * SECOND_US,
        ESCALATION_RULE: cfg.escalation_lookback_s * SECOND_US,
    }


def _by_rule(values: dict[str, int]) -> str:
    return "CASE rule_name " + " ".join(f"WHEN '{rule}' THEN {value}L" for rule, value in values.items()) + " END"


def _rule_rows(events: DataFrame, cfg: DetectConfig, only, carried: dict[str, str]) -> DataFrame:
    """One row per event and rule that looks at it: ``rule_name, key, part, window_us, bucket_us``, ``ts_us, event_seq`` and what is
    carried. ``part`` tells a rule's rows apart: the port, or 1 for a sudo and 0 for a failure."""
    ports = "source_ip IS NOT NULL AND destination_port IS NOT NULL"
    if cfg.port_scan_actions is not None:
        listed = ", ".join("'" + a.replace("\\", "\\\\").replace("'", "\\'") + "'" for a in cfg.port_scan_actions)
        ports += f" AND action IN ({listed})" if listed else " AND false"
    looks = {
        BRUTE_RULE: ("action = 'FAILED_LOGIN' AND source_ip IS NOT NULL", "source_ip", "0L"),
        SCAN_RULE: (ports, "source_ip", "CAST(destination_port AS bigint)"),
        ESCALATION_RULE: (
            "action IN ('FAILED_LOGIN', 'SUDO_COMMAND') AND user IS NOT NULL", "user", "if(action = 'SUDO_COMMAND', 1L, 0L)"
        ),
    }
    each = ", ".join(
        f"if({test}, named_struct('rule_name', '{rule}', 'key', {key}, 'part', {part}), null)"
        for rule, (test, key, part) in looks.items()
        if rule in only
    )
    windows = _windows_us(cfg)
    return events.selectExpr(
        f"inline(filter(array({each}), r -> r IS NOT NULL))",
        "unix_micros(event_ts) AS ts_us",
        "event_seq",
        *[f"{text} AS {name}" for name, text in carried.items()],
    ).selectExpr(
        "*", f"{_by_rule(windows)} AS window_us", f"{_by_rule({r: cfg.bucket_factor * w for r, w in windows.items()})} AS bucket_us"
    )


def task_count(events: DataFrame) -> int | None:
    """Tasks for the exchanges of ``events``, so that what one task sorts does not grow with the feed up to ``MOST_TASKS`` of them, and
    then by its share of the feed; none if Spark may choose, as a single task would do."""
    n = -(-events.count() // EVENTS_A_TASK)
    return max(min(n, MOST_TASKS), events.sparkSession.sparkContext.defaultParallelism) if n > 1 else None


def _deal(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.repartition(*_GROUP) if tasks is None else df.repartition(tasks, *_GROUP)


def _home(ts: str) -> str:
    return f"(({ts} - pmod({ts}, bucket_us)) div bucket_us)"


def _candidate_rows(events: DataFrame, cfg: DetectConfig, only, tasks: int | None = None) -> DataFrame:
    """Rows for the folds: candidates with ``q_*``, and for port scans the rows of bursts with enough ports, with ``port``."""
    spread = _deal(
        _rule_rows(events, cfg, only, {})
        .selectExpr("*", f"explode(sequence({_home('ts_us')}, {_home('(ts_us + 3L * window_us)')})) AS bucket")
        .selectExpr(
            *_GROUP, "part", "ts_us", "event_seq", "window_us",
            f"""CASE WHEN ts_us >= bucket * bucket_us THEN {_OWN} WHEN ts_us + window_us >= bucket * bucket_us THEN {_HALO}
              WHEN ts_us + 2L * window_us >= bucket * bucket_us THEN {_ENTRY} ELSE {_BEFORE} END AS zone""",
        ),
        tasks,
    )
    group = ", ".join(_GROUP)
    of_part = f"(PARTITION BY {group}, part ORDER BY ts_us, event_seq)"
    by_time = f"(PARTITION BY {group} ORDER BY ts_us, event_seq)"
    so_far = by_time[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    pos = "struct(ts_us, event_seq)"
    return (
        spread.selectExpr(
            "*",
            f"lag({pos}, {cfg.brute_threshold - 1}) OVER {of_part} AS nth_failure",
            f"lag({pos}, {cfg.escalation_min_failures - 1}) OVER {of_part} AS mth_failure",
            f"lag(ts_us) OVER {of_part} AS same_part_ts",
        )
        .selectExpr(
            "*",
            f"ts_us - lag(ts_us) OVER {by_time} <= window_us AS goes_on",
            # wrapped, so that a failure without an m-th latest one does not show an older row's value
            f"last(if(part = 0 AND rule_name = '{ESCALATION_RULE}', struct(mth_failure), null), true) OVER {so_far} AS latest",
        )
        .selectExpr(
            "*",
            f"max(if(coalesce(goes_on, false), null, ts_us)) OVER {so_far} AS burst_ts",
            f"""CASE rule_name WHEN '{BRUTE_RULE}' THEN nth_failure
              WHEN '{ESCALATION_RULE}' THEN if(part = 1, latest.mth_failure, null) END AS q""",
        )
        .where(f"rule_name = '{SCAN_RULE}' OR (zone <> {_BEFORE} AND q.ts_us >= ts_us - window_us)")
        # first uses of a port in its burst
        .selectExpr(
            "*", f"count_if(same_part_ts IS NULL OR same_part_ts < burst_ts) OVER (PARTITION BY {group}, burst_ts) AS ports_of_burst"
        )
        .where(f"rule_name <> '{SCAN_RULE}' OR ports_of_burst >= {cfg.scan_threshold}")
        .selectExpr(
            *_GROUP, "zone", "ts_us", "event_seq", "q.ts_us AS q_ts", "q.event_seq AS q_seq",
            f"if(rule_name = '{SCAN_RULE}', part, null) AS port",
        )
    )


def _candidates(batches, ports: int, scan_us: int):
    """Of rows for the folds, the candidates. A port scan's ``q`` is the last use of the N-th latest distinct port; only the N latest
    ports are kept."""
    group, latest = None, OrderedDict()
    for batch in batches:
        kept, q_times, q_seqs = [], [], []
        rows = _grouped((batch,), _GROUP, ("zone", "ts_us", "event_seq", "q_ts", "q_seq", "port"))
        for i, (found, zone, ts, seq, q_ts, q_seq, port) in enumerate(rows):
            if port is not None:
                if group != found:
                    group, latest = found, OrderedDict()
                latest.pop(port, None)
                latest[port] = (ts, seq)
                if len(latest) > ports:
                    latest.popitem(last=False)
                if zone == _BEFORE or len(latest) < ports:
                    continue
                q_ts, q_seq = next(iter(latest.values()))
                if q_ts < ts - scan_us:
                    continue
            kept.append(i)
            q_times.append(q_ts)
            q_seqs.append(q_seq)
        at = pa.array(kept, pa.int64())
        of = {"q_ts": pa.array(q_times, pa.int64()), "q_seq": pa.array(q_seqs, pa.int64())}
        columns = [of[f.name] if f.name in of else batch.column(f.name).take(at).cast(f.type) for f in _CANDIDATE_ARROW]
        yield pa.RecordBatch.from_arrays(columns, schema=_CANDIDATE_ARROW)


def shared_firings(
    events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, only=WINDOWED, tasks: int | None = None
) -> DataFrame:
    """Firings ``rule_name, key, ts_us, event_seq`` of the windowed rules in ``only``, equal to those of each rule alone. ``tasks`` is
    that of :func:`task_count`."""
    if cfg.bucket_factor < 2:
        raise ValueError("a bucket must be at least two windows wide")
    windows, factor = _windows_us(cfg), cfg.bucket_factor
    ports, scan_us = cfg.scan_threshold, windows[SCAN_RULE]
    names = [f.name for f in _CANDIDATE_ARROW]

    def limits(key):
        return windows[key[0]], factor * windows[key[0]]

    def candidates(batches):
        return _candidates(batches, ports, scan_us)

    def keyed(batches, *more):
        return _grouped(batches, names[:2], (*names[2:], *more))

    def handover(batches):
        found = handover_rows(keyed(batches), limits)
        return _emit(((*key, *rest) for key, *rest in found), _MAP_ARROW)

    def chain(batches):
        rows = _rows(batches, [f.name for f in _MAP_ARROW])
        found = chain_rows(((rule, key), *rest) for rule, key, *rest in rows)
        return _emit(((*key, *rest) for key, *rest in found), _STATE_ARROW)

    def fire(batches):
        def fold():
            group, last = None, _NONE
            for key, bucket, zone, ts, seq, q_ts, q_seq, last_ts, last_seq in keyed(batches, "last_ts", "last_seq"):
                if group != (key, bucket):
                    group, last = (key, bucket), _NONE if last_ts is None else (last_ts, last_seq)
                if zone == _OWN and last < (q_ts, q_seq):
                    yield (*key, ts, seq)
                    last = (ts, seq)

        return _emit(fold(), _FIRED_ARROW)

    in_order = (*_GROUP, "ts_us", "event_seq")
    # few and narrow beside the rows they come from, whose sorts and port fold are not to be done twice
    dealt = _candidate_rows(events, cfg, only, tasks).sortWithinPartitions(*in_order).select(*_FOLD_COLS)
    rows = _deal(materialize(dealt.mapInArrow(candidates, _CANDIDATE_DDL)), tasks)
    maps = rows.sortWithinPartitions(*in_order).mapInArrow(handover, _MAP_DDL)
    received = (
        maps.repartition("rule_name", "key")
        .sortWithinPartitions(*_GROUP, "in_ts", "in_seq")
        .mapInArrow(chain, _STATE_DDL)
    )
    # this exchange of the candidates is that of the first fold; the named repartitioning keeps groups whole in the join
    return (
        rows.join(_deal(received, tasks), list(_GROUP), "left")
        .sortWithinPartitions(*in_order)
        .select(*names, "last_ts", "last_seq")
        .mapInArrow(fire, _FIRED_DDL)
    )


def shared_evidence(
    events: DataFrame, fired: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, only=WINDOWED, tasks: int | None = None
) -> DataFrame:
    """Flat evidence: one row per event of a firing's window, with ``rule_name, key, bucket, trigger_ts, trigger_seq``, partitioned by
    ``(rule_name, key, bucket)``. ``fired`` should be stored, as it is read twice.

    Buckets with firings are counted and, if few enough to send to every task, only their events are shuffled."""
    windows = _windows_us(cfg)

    def copied(df):
        return df.selectExpr("*", f"explode(sequence({_home('ts_us')}, {_home('(ts_us + window_us)')})) AS bucket")

    carried = {f"event_{name}": name for name in (*EVIDENCE_FIELDS, "message")}
    rows = copied(_rule_rows(events, cfg, only, carried)).selectExpr(
        *_GROUP, "ts_us", "event_seq AS seq", "0 AS kind", "window_us",
        # only an escalation shows the message, that of its sudo
        *[f"if(rule_name = '{ESCALATION_RULE}', {c}, null) AS {c}" if n == "message" else c for c, n in carried.items()],
    )
    sized = fired.selectExpr(
        "*", f"{_by_rule(windows)} AS window_us", f"{_by_rule({r: cfg.bucket_factor * w for r, w in windows.items()})} AS bucket_us"
    )
    # a firing just before a bucket takes events that are copied there; it is marked there too, and given no rows
    marks = copied(sized).selectExpr(
        *_GROUP, "ts_us", "event_seq AS seq", "1 AS kind", "window_us",
        "struct(ts_us, event_seq, ts_us >= bucket * bucket_us AS own) AS fire",
    )
    hit = sized.selectExpr("rule_name", "key", f"{_home('ts_us')} AS bucket").distinct()
    if hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(hit), list(_GROUP), "left_semi")
    return (
        _deal(rows.unionByName(marks, allowMissingColumns=True), tasks)
        .selectExpr(
            "*",
            f"last(fire, true) OVER (PARTITION BY {', '.join(_GROUP)} ORDER BY ts_us DESC, seq DESC, kind DESC "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS next",
        )
        .where("kind = 0 AND next.own AND ts_us >= next.ts_us - window_us")
        .selectExpr(*_GROUP, "next.ts_us AS trigger_ts", "next.event_seq AS trigger_seq", *[f"{c} AS {n}" for c, n in carried.items()])
        # a sudo that did not fire is no evidence
        .where(
            f"rule_name <> '{ESCALATION_RULE}' OR action = 'FAILED_LOGIN' "
            "OR (event_seq = trigger_seq AND unix_micros(event_ts) = trigger_ts)"
        )
    )


def shared_alerts(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, only=WINDOWED) -> DataFrame:
    """Alerts of the windowed rules in ``only``, equal to those of each rule alone.

    Firings are stored first; they are narrow. ``cfg.evidence_cap`` shortens the shown array to the latest events; counts, users and
    ports stay whole."""
    tasks = task_count(events)
    fired = materialize(shared_firings(events, cfg, only, tasks))
    flat = shared_evidence(events, fired, cfg, only, tasks)
    group = (*_GROUP, "trigger_ts", "trigger_seq")
    # time first, so that sorting the structs sorts by time
    ordered = ", ".join(("event_ts", "event_seq", *(f for f in EVIDENCE_FIELDS if f not in ("event_ts", "event_seq"))))
    fields = ", ".join(f"e.{f} AS {f}" for f in EVIDENCE_FIELDS)
    shown = f"struct({ordered})"
    if cfg.evidence_cap is not None:
        latest = f"OVER (PARTITION BY {', '.join(group)} ORDER BY event_ts DESC, event_seq DESC)"
        flat = flat.selectExpr("*", f"row_number() {latest} AS nth")
        shown = f"if(nth <= {cfg.evidence_cap}, {shown}, null)"
    gathered = flat.groupBy(*group).agg(
        F.expr(f"transform(array_sort(collect_list({shown})), e -> struct({fields})) AS evidence"),
        F.expr("count(*) AS evidence_count"),
        F.expr("array_sort(collect_set(coalesce(user, 'unknown'))) AS users"),
        F.expr("array_sort(collect_set(destination_port)) AS ports"),
        F.expr("max(if(event_seq = trigger_seq, struct(message, source_ip), null)) AS trigger"),
    )
    forms = {
        BRUTE_RULE: rules.brute_force_form(cfg),
        SCAN_RULE: rules.port_scan_form(cfg),
        ESCALATION_RULE: rules.escalation_form(cfg),
    }
    return rules.alert_rows(
        gathered.selectExpr(
            "*", "coalesce(trigger.message, 'unknown') AS command", "coalesce(trigger.source_ip, 'local') AS source"
        ),
        {rule: form for rule, form in forms.items() if rule in only},
    )
