"""The driver tables seen as a security feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.scalar import ACTION_SEVERITY_SQL

_IP = "concat('10.0.', {n} div 250, '.', {n} % 250 + 1)"

# Event type -> action, then the message text of each action.
_ACTION = """CASE event_type WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'click' THEN 'CONNECTION'
  WHEN 'view' THEN 'ACCEPTED_LOGIN' WHEN 'signup' THEN 'BLOCKED' WHEN 'purchase' THEN 'SUDO_COMMAND' END"""
_BODY = """CASE action
  WHEN 'FAILED_LOGIN' THEN concat('Failed password for ', user, ' from ', source_ip, ' port ', k, ' ssh2')
  WHEN 'ACCEPTED_LOGIN' THEN concat('Accepted password for ', user, ' from ', source_ip, ' port ', k, ' ssh2')
  WHEN 'SUDO_COMMAND' THEN concat(user, ' : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/run', k)
  WHEN 'CONNECTION' THEN concat('connection from ', source_ip, ' port ', k)
  ELSE concat('BLOCKED IN=eth0 SRC=', source_ip, ' DST=10.1.0.1 DPT=', k, ' PROTO=TCP') END"""
_SERVICE = "CASE action WHEN 'SUDO_COMMAND' THEN 'sudo' WHEN 'BLOCKED' THEN 'kernel' ELSE 'sshd' END"


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.parquet`` as normalized events; ``raw`` is a syslog line of the same content."""
    return as_sec_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_sec_events(src: DataFrame) -> DataFrame:
    """Rows of the driver's event table, batch or stream, as normalized events."""
    return (
        src.selectExpr(
            "event_id AS event_seq",
            # whole micros since the epoch of the zone-less clock time, free of the session zone
            "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "
            "CAST(ts AS timestamp_ntz))) AS event_ts",
            "CAST(ts AS timestamp_ntz) AS event_wall",
            f"if(event_type = 'purchase', null, {_IP.format(n='user_id')}) AS source_ip",
            "concat('host', event_id % 7) AS hostname",
            f"{_ACTION} AS action",
            "if(event_type IN ('click', 'signup'), null, concat('u', user_id div 3)) AS user",
            "try_cast(get_json_object(props, '$.k') AS bigint) AS k",
        )
        .selectExpr(
            "*",
            f"{_SERVICE} AS service",
            f"{_BODY} AS body",
            "if(action = 'SUDO_COMMAND', null, k) AS destination_port",
            "CAST(event_seq AS string) AS pid",
        )
        .selectExpr(
            "event_seq",
            "event_ts",
            "event_wall",
            "false AS ts_inferred",
            "source_ip",
            "hostname",
            "service",
            "action",
            "user",
            "destination_port",
            f"{ACTION_SEVERITY_SQL.format(action='action')} AS severity",
            "concat(date_format(event_wall, 'MMM d HH:mm:ss'), ' ', hostname, ' ', service, '[', pid, ']: ', body) AS raw",
            "if(action = 'SUDO_COMMAND', concat('/bin/run', k), body) AS message",
            "pid",
            "CAST(null AS map<string,string>) AS metadata",
            "event_ts AS ingested_at",
        )
    )


def sec_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier.parquet`` as the reputation feed."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        f"{_IP.format(n='s_suppkey')} AS ip",
        "int(s_suppkey * 37 % 101) AS reputation_score",
        "array(concat('NATION_', s_nationkey), 'FEED') AS tags",
    )


def sec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as raw lines ``event_seq, line, ingested_at``."""
    return sec_events(spark, sf_dir).select("event_seq", F.col("raw").alias("line"), "ingested_at")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, as an unparsable feed: ``event_seq`` (the document), ``line``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("event_seq"),
        F.explode(F.split("text", "\n")).alias("line"),
        F.timestamp_seconds(F.lit(0)).alias("ingested_at"),
    )
