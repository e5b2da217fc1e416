"""From a stream to alerts, evidence, notifications and mitigations: each micro-batch is a load of the incremental job.

The sink writes everything of a micro-batch under its number and commits it by one row, so that a micro-batch that runs
again adds nothing. The reputation feed, the model and the destinations are functions that are asked in every micro-batch, so
that their joins follow what they hold then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.config import DEFAULT_CONFIG, DetectConfig
from sparkwarden.operators.enrich import enrich
from sparkwarden.plans.incremental import detect_load, detect_store
from sparkwarden.schema import ROUTES_INTENDED
from sparkwarden.sources import landing

Table = Callable[[SparkSession], DataFrame]
Sink = Callable[[DataFrame, int], None]


def alert_sink(
    path: str,
    intel: Table,
    cfg: DetectConfig = DEFAULT_CONFIG,
    routes=ROUTES_INTENDED,
    delay_s: int = 0,
    model: Table | None = None,
    destinations: Iterable[str] = (),
) -> Sink:
    """``foreachBatch`` sink of a stream of normalized events; results are the tables of :func:`detect_store` at ``path``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = detect_store(spark, path)
        last = store.last()
        if last is not None and last["load"] >= batch_id:
            return
        outlier = model(spark) if model else None
        detect_load(store, enrich(batch, intel(spark)), batch_id, cfg, routes, delay_s, outlier, destinations)

    return sink


def feed_sink(
    path: str,
    intel: Table,
    entries: landing.Entries = landing.as_lines,
    kinds: tuple[str, ...] = ("line",),
    year: int | None = None,
    **settings,
) -> Sink:
    """``foreachBatch`` sink of a stream of texts, as :func:`stream_texts` gives it: lands them with their numbers below
    ``<path>/landing``, their rejects below ``<path>/rejects``, and goes on as :func:`alert_sink` with ``settings``."""
    judge = alert_sink(path, intel, **settings)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = landing.landing_store(spark, f"{path}/landing")
        landing.land_rows(store, batch, batch_id, entries)
        events, rejects = landing.landed_events(landing.read_landed(store, batch_id), year, kinds)
        rejects.write.mode("overwrite").parquet(f"{path}/rejects/load={batch_id}")
        judge(events, batch_id)

    return sink


def stream_texts(spark: SparkSession, path: str, max_files: int = 100, **options) -> DataFrame:
    """Stream of the lines of a growing folder of text files, with their origin."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).options(**options)
    return landing.with_origin(reader.load(path))
