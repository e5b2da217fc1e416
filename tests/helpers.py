import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

ACTIONS = ["FAILED_LOGIN", "ACCEPTED_LOGIN", "SUDO_COMMAND", "CONNECTION", "BLOCKED", "OTHER"]


def random_events(seed, keys, per_key, span, ports=6, ips=None):
    """Small random sequences with many ties, nulls and bursts; times in whole seconds."""
    rng = random.Random(seed)
    events, seq = [], 0
    for k in range(keys):
        for _ in range(rng.randint(0, per_key)):
            action = rng.choices(ACTIONS, weights=[6, 1, 3, 2, 2, 1])[0]
            events.append(
                dict(
                    ts=rng.randint(0, span),
                    ip=None if rng.random() < 0.05 else f"10.0.{seed % 200}.{k}",
                    user=None if rng.random() < 0.05 else f"u{k}",
                    action=action,
                    port=None if rng.random() < 0.15 else rng.randint(-1, ports),
                )
            )
    rng.shuffle(events)
    for seq, e in enumerate(events):
        e["seq"] = seq
    return events


def events_df(spark, events, base=1_700_000_000):
    rows = [(e["seq"], base + e["ts"], e["ip"], e["user"], e["action"], e["port"], e.get("message")) for e in events]
    df = spark.createDataFrame(
        rows,
        "event_seq bigint, t bigint, source_ip string, user string, action string, destination_port bigint, "
        "message string",
    )
    ts = F.timestamp_seconds("t")
    return df.select(
        "event_seq",
        ts.alias("event_ts"),
        F.expr("cast(timestamp_seconds(t) as timestamp_ntz)").alias("event_wall"),
        F.lit(False).alias("ts_inferred"),
        "source_ip",
        F.lit("host0").alias("hostname"),
        F.lit("svc").alias("service"),
        "action",
        "user",
        "destination_port",
        F.lit("info").alias("severity"),
        F.concat(F.lit("line "), F.col("event_seq").cast("string")).alias("raw"),
        "message",
        F.lit(None).cast("string").alias("pid"),
        F.expr("cast(null as map<string,string>)").alias("metadata"),
        ts.alias("ingested_at"),
    )
