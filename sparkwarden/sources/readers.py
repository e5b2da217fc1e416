"""Sources of the feed: raw lines, JSON documents and bulk envelopes, as batch tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.normalize import (
    explode_bulk,
    normalize_json,
    normalize_parsed,
    parse_json_events,
    parse_syslog,
)


def _landed(df: DataFrame) -> DataFrame:
    """Text rows with an arrival number and the file's modification time as ingest time.

    The number is unique but depends on how the files are split, so fix it by storing the landed rows once.
    """
    return df.select(
        F.monotonically_increasing_id().alias("event_seq"),
        F.col("value"),
        F.col("_metadata.file_modification_time").alias("ingested_at"),
        F.col("_metadata.file_path").alias("file"),
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines ``event_seq, line, ingested_at, file`` of text files."""
    return _landed(spark.read.text(path)).withColumnRenamed("value", "line")


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per line, unparsed: ``event_seq, value, ingested_at, file``."""
    return _landed(spark.read.text(path))


def normalize_lines(lines: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)`` of raw lines."""
    parsed, rejects = parse_syslog(lines)
    return normalize_parsed(parsed, year), rejects


def normalize_docs(docs: DataFrame, year: int | None = None, reroute_raw: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)`` of JSON texts; ``{"raw": line}`` documents go through the line parser."""
    rows, raw, rejects = parse_json_events(docs, reroute_raw)
    if not reroute_raw:
        return normalize_json(rows), rejects
    events, bad_lines = normalize_lines(raw, year)
    return normalize_json(rows).unionByName(events), rejects.unionByName(bad_lines)


def read_json_events(spark: SparkSession, path: str, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)`` of JSON-lines files."""
    return normalize_docs(read_json_texts(spark, path), year)


def normalize_bulk(envelopes: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)`` of bulk envelopes; their documents are never rerouted to the line parser. A broken envelope is
    a reject too."""
    lines, docs, bad_envelopes = explode_bulk(envelopes)
    from_lines, bad_lines = normalize_lines(lines, year)
    from_docs, bad_docs = normalize_docs(docs, year, reroute_raw=False)
    return from_lines.unionByName(from_docs), bad_lines.unionByName(bad_docs).unionByName(bad_envelopes)


def stream_events(
    spark: SparkSession,
    path: str,
    schema,
    fmt: str = "parquet",
    max_files: int = 100,
    **options,
) -> DataFrame:
    """Stream of a growing folder of event files with a fixed schema.

    A message bus is the same call with another ``fmt`` and ``options``, if its connector is on the class path.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(path)
