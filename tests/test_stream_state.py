"""Stream state without a stream: folds against the sequential rules, idle windows, blocked flag, hold-back."""

import pandas as pd

from sparkwarden.config import DetectConfig
from sparkwarden.streaming.state import SourceRules, UserRules
from tests import naive
from tests.helpers import random_events

US = 1_000_000


class Cell:
    """One state variable of one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def clear(self):
        self.value = None

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = (self.value or []) + list(rows)


class Handle:
    def __init__(self):
        self.cells, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.cells.setdefault(name, Cell())

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def opened(rules):
    rules.init(Handle())
    return rules


def rows(events):
    return pd.DataFrame(
        [(e["ts"] * US, e["seq"], e["action"], e["user"], e["port"], 0) for e in events],
        columns=["ts_us", "event_seq", "action", "user", "port", "score"],
    )


def fired(frames):
    return [(r.rule_name, int(r.event_seq)) for f in frames for r in f.itertuples() if r.kind == "fired"]


def test_folds_equal_the_sequential_rules():
    cfg = DetectConfig(brute_threshold=3, brute_window_s=6, scan_threshold=4, scan_window_s=8, escalation_lookback_s=9)
    for seed in range(60):
        ev = [e for e in random_events(seed, 1, 80, 90) if e["ip"] and e["user"]]
        source, user = opened(SourceRules(cfg, frozenset(), False)), opened(UserRules(cfg, False))
        logins = [e for e in ev if e["action"] in ("FAILED_LOGIN", "SUDO_COMMAND")]
        got = fired(source.handleInputRows(("k",), iter([rows(ev)]), None))
        got += fired(user.handleInputRows(("k",), iter([rows(logins)]), None))
        want = [("brute_force_ssh", s) for _, s, _ in naive.brute_force(ev, 3, 6)]
        want += [("port_scan", s) for _, s, _ in naive.port_scan(ev, 4, 8)]
        want += [("privilege_escalation", s) for _, s, _ in naive.escalation(ev, 1, 9)]
        assert sorted(got) == sorted(want)


def ev(seq, ts, action="FAILED_LOGIN", port=1):
    return dict(seq=seq, ts=ts, action=action, user="u", ip="k", port=port)


def test_idle_windows_go_and_the_block_stays():
    cfg = DetectConfig(brute_threshold=2)
    rules = opened(SourceRules(cfg, frozenset({"brute_force_ssh"}), False))
    list(rules.handleInputRows(("k",), iter([rows([ev(0, 0)])]), None))
    cells, timers = rules.handle.cells, rules.handle.timers
    assert cells["failures"].exists() and cells["ports"].exists() and timers == [60_001]
    list(rules.handleExpiredTimer(("k",), Clock(30_000), None))
    assert cells["failures"].exists()
    list(rules.handleExpiredTimer(("k",), Clock(61_000), None))
    assert not cells["failures"].exists() and not cells["ports"].exists() and not cells["blocked"].exists()

    out = pd.concat(rules.handleInputRows(("k",), iter([rows([ev(1, 100), ev(2, 101), ev(3, 102)])]), None))
    assert list(out.kind) == ["kept", "kept", "fired", "dropped"]
    list(rules.handleExpiredTimer(("k",), Clock(10**9), None))
    assert cells["blocked"].exists() and not cells["failures"].exists()
    out = pd.concat(rules.handleInputRows(("k",), iter([rows([ev(4, 10**6)])]), None))
    assert list(out.kind) == ["dropped"]


def test_rows_are_held_until_the_watermark_and_then_ordered():
    rules = opened(SourceRules(DetectConfig(), frozenset(), True))
    assert list(rules.handleInputRows(("k",), iter([rows([ev(2, 20), ev(0, 5)])]), None)) == []
    assert list(rules.handleInputRows(("k",), iter([rows([ev(1, 10)])]), None)) == []
    out = pd.concat(rules.handleExpiredTimer(("k",), Clock(12_000), None))
    assert list(out.event_seq) == [0, 1] and len(rules.held.get()) == 1
    assert 20_001 in rules.handle.timers
    out = pd.concat(rules.handleExpiredTimer(("k",), Clock(20_001), None))
    assert list(out.event_seq) == [2] and not rules.held.exists()
