"""Keyed rules over streams: state per source and per user, with the block feedback inside the state.

A key's rows are handled in ``(ts, seq)`` order. ``emit="ordered"`` holds rows back until the watermark passes them,
so that late rows inside the delay still take their place and results equal the batch rules; ``emit="eager"`` handles each
micro-batch at once and orders rows only inside it.

State per source is the last T-1 failures, the latest N-1 ports and the blocked flag; idle windows are dropped by a
timer, the blocked flag never is.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.timebuckets import SECOND_US
from sparkwarden.schema import BLOCK_PLAYBOOK, BRUTE_RULE, ESCALATION_RULE, INTEL_RULE, ROUTES_INTENDED, SCAN_RULE

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW_COLUMNS = ("ts_us", "event_seq", "action", "user", "port", "score")
_ROW_DDL = "ts_us bigint, event_seq bigint, action string, user string, port bigint, score int"
_OUT_COLUMNS = ("kind", "rule_name", "key", "ts_us", "event_seq", "action", "user")
OUT_DDL = "kind string, rule_name string, key string, ts_us bigint, event_seq bigint, action string, user string"


def _value(x):
    """A cell of a pandas column as a plain value."""
    return None if x is None or x is pd.NA or x != x else x


def _int(x):
    x = _value(x)
    return None if x is None else int(x)


class _Ordered(StatefulProcessor):
    """Rows of one key in time order, with the hold-back of ``ordered`` emission and a clean-up timer."""

    window_us = 0

    def __init__(self, ordered: bool):
        self.ordered = ordered

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", _ROW_DDL)
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for pdf in rows:
            columns = [pdf[c].tolist() for c in _ROW_COLUMNS]
            new += [
                (int(t), int(s), _value(a), _value(u), _int(p), _int(sc) or 0) for t, s, a, u, p, sc in zip(*columns)
            ]
        if self.ordered:
            # held until the watermark passes; the earliest row's timer brings the key back
            self.held.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
            return
        yield from self._run(key[0], sorted(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.held.get()] if self.ordered and self.held.exists() else []
        due = sorted(r for r in rows if r[0] <= now_us)
        if not due:
            self.forget(now_us - self.window_us)
            return
        left = [r for r in rows if r[0] > now_us]
        if left:
            self.held.put(left)
            self.handle.registerTimer(min(left)[0] // 1000 + 1)
        else:
            self.held.clear()
        yield from self._run(key[0], due)

    def _run(self, key, rows):
        if not rows:
            return
        out = list(self.fold(key, rows))
        self.handle.registerTimer((rows[-1][0] + self.window_us) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=list(_OUT_COLUMNS))

    def close(self):
        pass


class SourceRules(_Ordered):
    """Reputation, brute-force and port-scan rules of one source, and its block."""

    def __init__(self, cfg: DetectConfig, blocking: frozenset[str], ordered: bool):
        super().__init__(ordered)
        self.cfg, self.blocking = cfg, blocking
        self.brute_us, self.scan_us = cfg.brute_window_s * SECOND_US, cfg.scan_window_s * SECOND_US
        self.window_us = max(self.brute_us, self.scan_us)

    def open(self, handle):
        self.failures = handle.getValueState("failures", "ts array<bigint>")
        self.ports = handle.getValueState("ports", "port array<bigint>, ts array<bigint>")
        self.blocked = handle.getValueState("blocked", "blocked boolean")

    def fold(self, key, rows):
        cfg = self.cfg
        failures = list(self.failures.get()[0]) if self.failures.exists() else []
        latest = OrderedDict(zip(*self.ports.get())) if self.ports.exists() else OrderedDict()
        was_blocked = blocked = self.blocked.exists()
        for ts, seq, action, user, port, score in rows:
            if blocked:
                yield ("dropped", None, key, ts, seq, action, user)
                continue
            yield ("kept", None, key, ts, seq, action, user)
            fired = []
            if score >= cfg.intel_min_score:
                fired.append(INTEL_RULE)
            if action == "FAILED_LOGIN":
                failures = [t for t in failures if t >= ts - self.brute_us] + [ts]
                if len(failures) >= cfg.brute_threshold:
                    fired.append(BRUTE_RULE)
                    failures = []
            if port is not None and (cfg.port_scan_actions is None or action in cfg.port_scan_actions):
                latest.pop(port, None)
                latest[port] = ts
                while next(iter(latest.values())) < ts - self.scan_us:
                    latest.popitem(last=False)
                if len(latest) >= cfg.scan_threshold:
                    fired.append(SCAN_RULE)
                    latest.clear()
            for rule in fired:
                yield ("fired", rule, key, ts, seq, action, user)
            blocked = any(rule in self.blocking for rule in fired)
        if blocked and not was_blocked:
            self.blocked.update((True,))
        self._keep(failures, latest)

    def _keep(self, failures, latest):
        self.failures.update((failures,)) if failures else self.failures.clear()
        self.ports.update((list(latest), list(latest.values()))) if latest else self.ports.clear()

    def forget(self, before_us):
        failures = [t for t in self.failures.get()[0] if t >= before_us] if self.failures.exists() else []
        latest = OrderedDict(zip(*self.ports.get())) if self.ports.exists() else OrderedDict()
        self._keep(failures, OrderedDict((p, t) for p, t in latest.items() if t >= before_us))


class UserRules(_Ordered):
    """Escalation rule of one user."""

    def __init__(self, cfg: DetectConfig, ordered: bool):
        super().__init__(ordered)
        self.cfg = cfg
        self.window_us = cfg.escalation_lookback_s * SECOND_US

    def open(self, handle):
        self.failures = handle.getValueState("failures", "ts array<bigint>")

    def fold(self, key, rows):
        failures = list(self.failures.get()[0]) if self.failures.exists() else []
        for ts, seq, action, user, _, _ in rows:
            failures = [t for t in failures if t >= ts - self.window_us]
            if action == "FAILED_LOGIN":
                failures.append(ts)
            elif len(failures) >= self.cfg.escalation_min_failures:
                failures = []
                yield ("fired", ESCALATION_RULE, key, ts, seq, action, user)
        self.failures.update((failures,)) if failures else self.failures.clear()

    def forget(self, before_us):
        if self.failures.exists():
            left = [t for t in self.failures.get()[0] if t >= before_us]
            self.failures.update((left,)) if left else self.failures.clear()


def _keyed(events: DataFrame, key: str) -> DataFrame:
    """Rows of the keyed rules; ``event_ts`` must carry the watermark."""
    score = "intel.reputation_score" if "intel" in events.columns else "CAST(null AS int)"
    return events.filter(f"{key} IS NOT NULL").selectExpr(
        f"{key} AS key",
        "event_ts",
        "unix_micros(event_ts) AS ts_us",
        "event_seq",
        "action",
        "user",
        "destination_port AS port",
        f"coalesce({score}, 0) AS score",
    )


def _check(emit: str) -> bool:
    if emit not in ("ordered", "eager"):
        raise ValueError("emit is 'ordered' or 'eager'")
    return emit == "ordered"


def stream_ip_rules(
    events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, routes=ROUTES_INTENDED, emit: str = "ordered"
) -> DataFrame:
    """Rows ``kept``, ``dropped`` and ``fired`` of every source, see :data:`OUT_DDL`.

    ``events`` is an enriched stream with a watermark on ``event_ts``. Events without a source are not in the result:
    they are never blocked and meet no rule by source.
    """
    blocking = frozenset(rule for rule, playbook in routes if playbook == BLOCK_PLAYBOOK)
    return (
        _keyed(events, "source_ip")
        .groupBy("key")
        .transformWithStateInPandas(SourceRules(cfg, blocking, _check(emit)), OUT_DDL, "append", "eventtime")
    )


def stream_user_rules(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, emit: str = "ordered") -> DataFrame:
    """``fired`` rows of the escalation rule over the events that were kept."""
    rows = events.filter("action IN ('FAILED_LOGIN', 'SUDO_COMMAND')")
    return (
        _keyed(rows, "user")
        .groupBy("key")
        .transformWithStateInPandas(UserRules(cfg, _check(emit)), OUT_DDL, "append", "eventtime")
    )
