"""Rules against the sequential restatement, over random sequences with ties and nulls and narrow buckets."""

import pytest

from sparkwarden.config import DetectConfig
from sparkwarden.operators.brute_force import brute_force_firings
from sparkwarden.operators.port_scan import port_scan_firings
from sparkwarden.operators.priv_escalation import escalation_firings
from tests import naive
from tests.helpers import events_df, random_events


def fired(df):
    return sorted((r.key, r.event_seq) for r in df.collect())


SHAPES = [(1, 300, 40, 60), (2, 40, 300, 200), (3, 4, 2500, 1500)]


@pytest.mark.parametrize("seed,keys,per_key,span", SHAPES)
@pytest.mark.parametrize("factor", [2, 16])
def test_brute_force(spark, seed, keys, per_key, span, factor):
    ev = random_events(seed, keys, per_key, span)
    for t, w in [(1, 4), (3, 5)] if factor == 16 else [(3, 5), (5, 7)]:
        cfg = DetectConfig(brute_threshold=t, brute_window_s=w, bucket_factor=factor)
        want = sorted((k, s) for k, s, _ in naive.brute_force(ev, t, w))
        assert want and fired(brute_force_firings(events_df(spark, ev), cfg)) == want


@pytest.mark.parametrize("seed,keys,per_key,span", SHAPES)
@pytest.mark.parametrize("factor", [2, 16])
def test_port_scan(spark, seed, keys, per_key, span, factor):
    ev = random_events(seed, keys, per_key, span, ports=9)
    for n, w in [(2, 3), (4, 6)] if factor == 16 else [(4, 6), (6, 12)]:
        cfg = DetectConfig(scan_threshold=n, scan_window_s=w, bucket_factor=factor)
        want = sorted((k, s) for k, s, _ in naive.port_scan(ev, n, w))
        assert want and fired(port_scan_firings(events_df(spark, ev), cfg)) == want


@pytest.mark.parametrize("seed,keys,per_key,span", SHAPES)
@pytest.mark.parametrize("factor", [2, 16])
def test_escalation(spark, seed, keys, per_key, span, factor):
    ev = random_events(seed, keys, per_key, span)
    for m, w in [(1, 8), (3, 9)] if factor == 16 else [(1, 2), (2, 6)]:
        cfg = DetectConfig(escalation_min_failures=m, escalation_lookback_s=w, bucket_factor=factor)
        want = sorted((k, s) for k, s, _ in naive.escalation(ev, m, w))
        assert want and fired(escalation_firings(events_df(spark, ev), cfg)) == want
