"""Port-scan rule: N distinct destination ports of one source within W seconds."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.rearm import _emit, _grouped, firings
from sparkwarden.operators.timebuckets import SECOND_US, with_halo

_LATEST_ARROW = pa.schema(
    [pa.field("key", pa.string())] + [pa.field(n, pa.int64()) for n in ("ts_us", "event_seq", "q_ts", "q_seq")]
)
_LATEST_DDL = "key string, ts_us bigint, event_seq bigint, q_ts bigint, q_seq bigint"


def port_events(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Rows with a source and a port. Any action counts, as the port is what the rule looks at; an ssh client port
    counts too. ``cfg.port_scan_actions`` narrows the actions."""
    rows = events.filter("source_ip IS NOT NULL AND destination_port IS NOT NULL")
    if cfg.port_scan_actions is not None:
        rows = rows.filter(F.col("action").isin(*cfg.port_scan_actions))
    return rows


def _latest_ports(threshold: int, window_us: int):
    """For each row, the last use of the N-th latest distinct port; only the N latest ports are kept as state."""

    def fold(rows):
        group, latest = None, OrderedDict()
        for found, ts, seq, port, is_halo in rows:
            if group != found:
                group, latest = found, OrderedDict()
            latest.pop(port, None)
            latest[port] = (ts, seq)
            if len(latest) > threshold:
                latest.popitem(last=False)
            if not is_halo and len(latest) == threshold:
                q = next(iter(latest.values()))
                if q[0] >= ts - window_us:
                    yield (found[0], ts, seq, *q)

    names = ("ts_us", "event_seq", "destination_port", "is_halo")
    return lambda batches: _emit(fold(_grouped(batches, ("key", "bucket"), names)), _LATEST_ARROW)


def port_scan_candidates(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Rows with N or more distinct ports in ``[t - W, t]``; ``q_*`` is the last use of the N-th latest port.

    Groups of fewer than N rows cannot fire and are dropped before Python sees them. One shuffle and one sort serve
    the row count and the fold.
    """
    window_us = cfg.scan_window_s * SECOND_US
    rows = port_events(events, cfg).selectExpr(
        "source_ip AS key", "unix_micros(event_ts) AS ts_us", "event_seq", "destination_port"
    )
    order = "PARTITION BY key, bucket ORDER BY ts_us, event_seq"
    return (
        with_halo(rows, window_us, cfg.bucket_factor * window_us)
        .repartition("key", "bucket")
        .selectExpr("*", f"count(*) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n")
        .filter(f"n >= {cfg.scan_threshold}")
        .sortWithinPartitions("key", "bucket", "ts_us", "event_seq")
        .select("key", "bucket", "ts_us", "event_seq", "destination_port", "is_halo")
        .mapInArrow(_latest_ports(cfg.scan_threshold, window_us), _LATEST_DDL)
    )


def port_scan_firings(events: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """Rows that fire the rule; each firing empties the window and re-arms it."""
    window_us = cfg.scan_window_s * SECOND_US
    return firings(port_scan_candidates(events, cfg), window_us, cfg.bucket_factor * window_us)
