"""Streams without keyed Python state: enrichment, lateness, rates, sessions, features, and exactly-once sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.enrich import enrich
from sparkwarden.operators.features import feature_matrix
from sparkwarden.sources.tables import write_alerts
from sparkwarden.streaming.state import STATE_STORE


def with_lateness(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark ``delay`` behind the newest event; rows behind it are dropped by stateful operators and
    counted in the query's progress (``numRowsDroppedByWatermark``)."""
    return events.withWatermark("event_ts", delay)


def stream_enrich(events: DataFrame, intel: DataFrame) -> DataFrame:
    """Reputation of each streamed event from a static feed as it is when the stream is defined. A feed that changes is joined
    in the sink: see :func:`sparkwarden.streaming.alerts.alert_sink`."""
    return enrich(events, intel)


def event_rates(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events per window and action; a window is emitted once, when the watermark has passed its end."""
    window = F.window("event_ts", width, slide or width)
    return events.groupBy(window.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "w.start AS start", "w.end AS end", "action", "n"
    )


def sessions(events: DataFrame, gap: str, key: str = "source_ip") -> DataFrame:
    """Bursts of one key: runs of events no further than ``gap`` apart, with their event count and distinct ports."""
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(F.session_window("event_ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.expr("size(collect_set(destination_port)) AS ports"))
        .selectExpr(key, "w.start AS start", "w.end AS end", "n", "ports")
    )


def _table(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, replaced if the batch runs again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_alerts(path: str):
    """``foreachBatch`` sink: alerts are appended once each, also if a batch is repeated."""
    return lambda batch, batch_id: write_alerts(batch, path)


def land(path: str, late_path: str, delay_s: int):
    """``foreachBatch`` sink that stores each event in ``path``, or in ``late_path`` if it is more than ``delay_s`` behind
    the newest event of the earlier batches. Late events are kept for a batch rerun, not lost."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = _table(spark, f"{path}-marks")
        high = None
        if marks is not None:
            high = marks.filter(F.col("batch") < batch_id).agg(F.max("high_us")).first()[0]
        late = F.lit(False) if high is None else F.unix_micros("event_ts") < high - delay_s * 1_000_000
        batch = batch.withColumn("_late", late).persist()
        try:
            _write_batch(batch.filter("NOT _late").drop("_late"), path, batch_id)
            _write_batch(batch.filter("_late").drop("_late"), late_path, batch_id)
            newest = batch.agg(F.max(F.unix_micros("event_ts")).alias("high_us"))
            _write_batch(newest, f"{path}-marks", batch_id)
        finally:
            batch.unpersist()

    return sink


def stream_features(store: str, path: str, cfg: DetectConfig = DEFAULT_CONFIG):
    """``foreachBatch`` sink: feature rows of the new events, computed over them and the stored events of one window
    before them. Uses the batch operator, so a busy source is split over tasks here too.

    Each micro-batch lands in ``store`` first; features see every event that landed so far.
    """
    window_us = cfg.feature_window_s * 1_000_000

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write_batch(batch, store, batch_id)
        landed = spark.read.parquet(store).filter(F.col("batch") <= batch_id)
        new = landed.filter(F.col("batch") == batch_id)
        span = new.agg(F.min(F.unix_micros("event_ts")), F.max(F.unix_micros("event_ts"))).first()
        if span[0] is None:
            return
        ts = F.unix_micros("event_ts")
        near = landed.filter((ts > span[0] - window_us) & (ts <= span[1]))
        rows = feature_matrix(near, cfg, ("batch",)).filter(F.col("batch") == batch_id).drop("batch")
        _write_batch(rows, path, batch_id)

    return sink


def use_state_store(spark) -> None:
    """Keyed Python state needs this provider; it keeps state on local disk and its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, sink=None) -> None:
    """Run a stream over all input there is, to files in ``path`` or through the ``foreachBatch`` function ``sink``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error
