"""Outlier rule: events that the fitted forest calls unusual for their behaviour features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.alerts import make_alerts, single_event
from sparkwarden.operators.evidence import EVIDENCE_FIELDS
from sparkwarden.operators.features import feature_matrix
from sparkwarden.operators.iforest import predict
from sparkwarden.schema import ANOMALY_RULE, FEATURE_NAMES


def anomaly_hits(events: DataFrame, model: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG, keep=()) -> DataFrame:
    """``event_seq``, ``keep``, features and score of outlying events with a source."""
    located = events.filter("source_ip IS NOT NULL")
    return predict(feature_matrix(located, cfg, keep), model).filter("is_outlier")


def anomaly_alerts(events: DataFrame, model: DataFrame, cfg: DetectConfig = DEFAULT_CONFIG) -> DataFrame:
    """One alert per outlying event, with the features that explain it."""
    keep = tuple(f for f in EVIDENCE_FIELDS if f != "event_seq")
    hits = single_event(anomaly_hits(events, model, cfg, keep))
    text = (
        "format_string('Machine Learning Anomaly: Activity from %s is highly unusual compared to the historical "
        "baseline. Action: %s, Time: Hour %d.', source_ip, action, hour_of_day)"
    )
    details = {"model": "'IsolationForest'", "features": f"struct({', '.join(FEATURE_NAMES)})"}
    return make_alerts(hits, ANOMALY_RULE, {"source_ip": "source_ip", "description": text}, details)
