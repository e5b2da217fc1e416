"""Event, alert, mitigation and outbox tables on parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.respond import dispatch, webhook_payload


def write_events(events: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Append events by day, sorted by source and time inside each file.

    The day prunes time filters and the sort gives narrow source ranges per row group, so source lookups skip files.
    ``files_per_day`` spreads each day over that many tasks by a hash of the event, so a busy source is no hot task;
    without it rows stay in the tasks they are in, and nothing is shuffled.
    """
    dated = events.withColumn("event_date", F.col("event_wall").cast("date"))
    if files_per_day is not None:
        part = F.pmod(F.xxhash64("event_seq"), F.lit(files_per_day))
        dated = dated.withColumn("_part", part).repartition("event_date", "_part").drop("_part")
    (
        dated.sortWithinPartitions("event_date", "source_ip", "event_ts")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose ``key`` is not stored yet; a repeated or retried append adds nothing twice."""
    df = df.dropDuplicates([key])
    old = _stored(df.sparkSession, path)
    if old is not None:
        df = df.join(old.select(key), key, "left_anti").select(*df.columns)
    df.write.mode("append").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    append_new(alerts, path, "alert_id")


def write_mitigations(mitigations: DataFrame, path: str) -> None:
    """Append mitigations; one per alert and action."""
    keyed = mitigations.withColumn(
        "mitigation_id", F.sha2(F.concat_ws("|", "triggering_alert_id", "playbook", "action", "target"), 256)
    )
    append_new(keyed, path, "mitigation_id")


def outbox_rows(alerts: DataFrame, destinations, min_severity: str = "high") -> DataFrame:
    """Notification rows for a sender to deliver: one per alert and destination."""
    return webhook_payload(dispatch(alerts, destinations, min_severity)).select(
        F.sha2(F.concat_ws("|", "alert_id", "destination"), 256).alias("message_id"),
        "alert_id",
        "destination",
        "payload",
        "created_at",
    )


def write_outbox(alerts: DataFrame, path: str, destinations, min_severity: str = "high") -> None:
    """Append notification rows, each once."""
    append_new(outbox_rows(alerts, destinations, min_severity), path, "message_id")
