"""Detection settings, passed explicitly to every rule."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DetectConfig:
    """Thresholds and windows of the detection rules.

    ``bucket_factor`` sets the width of the time buckets that split a busy key over tasks: a bucket is
    ``bucket_factor`` windows wide, and ``2 / bucket_factor`` is the largest share of rows copied to a neighbour.

    ``stored_firings`` makes each rule two jobs: its firings, narrow and stored, then the evidence of just the buckets they
    fall into. Worth it where events are many and alerts few; the batch job sets it when it has an event store.
    """

    # Fixed default values
    brute_threshold: int = 5
    brute_window_s: int = 60
    scan_threshold: int = 10
    scan_window_s: int = 30
    escalation_lookback_s: int = 300
    escalation_min_failures: int = 1
    intel_min_score: int = 80
    feature_window_s: int = 60
    min_severity: str = "high"

    port_scan_actions: tuple[str, ...] | None = None
    evidence_cap: int | None = None
    bucket_factor: int = 16
    stored_firings: bool = False

    def __post_init__(self):
        if self.bucket_factor < 2:
            raise ValueError("bucket_factor must be at least 2")
        for name in ("brute_threshold", "scan_threshold", "escalation_min_failures"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def with_(self, **changes) -> "DetectConfig":
        return replace(self, **changes)


DEFAULT_CONFIG = DetectConfig()
