"""Sequential restatements of the rules, one event at a time, to compare the Spark operators with."""

from collections import defaultdict


def ordered(events):
    return sorted(events, key=lambda e: (e["ts"], e["seq"]))


def sliding_rule(events, key, wanted, token, threshold, window, trigger=None):
    """Fire when the window holds ``threshold`` distinct tokens at a trigger row, then empty it."""
    state, fired = defaultdict(list), []
    for e in ordered(events):
        k = e[key]
        if k is None:
            continue
        adds, fires = wanted(e), (trigger or wanted)(e)
        if not adds and not fires:
            continue
        if adds:
            state[k].append((e["ts"], token(e), e["seq"]))
        state[k] = [x for x in state[k] if x[0] >= e["ts"] - window]
        if fires and len({x[1] for x in state[k]}) >= threshold:
            evidence = [x[2] for x in state[k]]
            fired.append((k, e["seq"], tuple(evidence)))
            state[k] = []
    return fired


def brute_force(events, threshold, window):
    return sliding_rule(
        events, "ip", lambda e: e["action"] == "FAILED_LOGIN", lambda e: e["seq"], threshold, window
    )


def port_scan(events, threshold, window):
    return sliding_rule(events, "ip", lambda e: e["port"] is not None, lambda e: e["port"], threshold, window)


def escalation(events, min_failures, lookback):
    return sliding_rule(
        events,
        "user",
        lambda e: e["action"] == "FAILED_LOGIN",
        lambda e: e["seq"],
        min_failures,
        lookback,
        trigger=lambda e: e["action"] == "SUDO_COMMAND",
    )


def features(events, window):
    """seq -> (velocity, distinct ports) over (t - window, t], peers included; null sources count nothing."""
    out = {}
    for e in events:
        if e["ip"] is None:
            out[e["seq"]] = (0, 0)
            continue
        peers = [x for x in events if x["ip"] == e["ip"] and e["ts"] - window < x["ts"] <= e["ts"]]
        out[e["seq"]] = (len(peers), len({x["port"] for x in peers} - {None, -1}))
    return out
