"""Reputation enrichment of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.joins import LOOKUP_ROWS, lookup_join
from sparkwarden.plans.materialize import materialize
from sparkwarden.schema import INTEL_TYPE

# The sample reputation feed and the provider name written to enriched events.
PROVIDER = "mock_ti"
SAMPLE_INTEL = (
    ("185.220.101.1", 95, ["TOR_EXIT_NODE", "ANONYMIZER"]),
    ("45.33.32.156", 88, ["BRUTE_FORCER", "BOTNET"]),
    ("104.244.72.100", 75, ["SCANNER", "MALICIOUS_CRAWLER"]),
)


def sample_intel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_INTEL), "ip string, reputation_score int, tags array<string>")


def enrich(events: DataFrame, intel: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Add ``intel``; sources that are unknown or null get score 0, no tags and ``malicious = false``.

    Of several rows of one ``ip`` the one with the highest score counts, of equal scores the one whose tags sort last, so
    that no event is doubled. See :func:`lookup_join` for how the feed's size picks the join.
    """
    worst = intel.where("ip IS NOT NULL").groupBy("ip").agg(F.max(F.struct("reputation_score", "tags")).alias("row"))
    # stored once: the feed is counted and joined, and the events' side needs no exchange for it
    dim = materialize(worst.selectExpr("ip AS source_ip", "row.reputation_score", "row.tags"))
    joined = lookup_join(events, dim, "source_ip", max_rows=max_rows)
    return joined.selectExpr(
        *events.columns,
        "CAST(named_struct('reputation_score', coalesce(reputation_score, 0), 'tags', coalesce(tags, array()), "
        f"'provider', '{PROVIDER}', 'malicious', reputation_score IS NOT NULL) AS {INTEL_TYPE}) AS intel",
    )
