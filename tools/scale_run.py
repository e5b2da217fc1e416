"""Scaling run: the driver's events repeated ``copies`` times with a third of all rows on one source.

``scale_run.py [sf_dir] [copies ...]`` prints seconds per operator, and for the windowed ones the largest task's share of
the rows that its shuffle read, taken from partition sizes.
"""

import os
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sparkwarden.config import DetectConfig  # noqa: E402
from sparkwarden.operators import alerts as rules  # noqa: E402
from sparkwarden.operators.brute_force import brute_force_firings  # noqa: E402
from sparkwarden.operators.enrich import enrich  # noqa: E402
from sparkwarden.operators.features import window_features  # noqa: E402
from sparkwarden.operators.port_scan import port_scan_firings  # noqa: E402
from sparkwarden.operators.priv_escalation import escalation_firings  # noqa: E402
from sparkwarden.operators.timebuckets import SECOND_US, with_halo  # noqa: E402
from sparkwarden.plans.materialize import shared_dir  # noqa: E402
from sparkwarden.plans.batch import run_batch  # noqa: E402
from sparkwarden.sources.adapter import sec_events, sec_intel  # noqa: E402


def repeated(spark, sf, copies):
    """Copies are 7 s apart; every third row, whatever its source was, comes from one source and one user."""
    ev = sec_events(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hot = "pmod(xxhash64(event_seq, copy), 3) = 0"
    return ev.selectExpr(
        f"event_seq * {copies} + copy AS event_seq",
        "timestamp_micros(unix_micros(event_ts) + copy * 7000000L) AS event_ts",
        "event_wall", "ts_inferred",
        f"if({hot} AND source_ip IS NOT NULL, '10.9.9.9', source_ip) AS source_ip",
        "hostname", "service", "action",
        f"if({hot} AND user IS NOT NULL, 'hot', user) AS user",
        "destination_port", "severity", "raw", "message", "pid", "metadata", "ingested_at",
    )


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    sizes = [int(a) for a in sys.argv[2:]] or [5, 20]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cfg = DetectConfig(brute_window_s=60, brute_threshold=4)
    for copies in sizes:
        path = f"{shared_dir(spark)}/scale-{uuid.uuid4().hex}"
        repeated(spark, sf, copies).repartition(16, "event_seq").write.parquet(path)
        ev = spark.read.parquet(path)
        n = ev.count()
        rows = ev.filter("source_ip IS NOT NULL").selectExpr("source_ip AS key", "unix_micros(event_ts) AS ts_us")
        spread = with_halo(rows, 60 * SECOND_US, 16 * 60 * SECOND_US)
        for name, keys in (("by source", ("key",)), ("by source and bucket", ("key", "bucket"))):
            sizes_ = [r["count"] for r in spread.repartition(32, *keys).groupBy(F.spark_partition_id()).count().collect()]
            print(f"{n} rows, {name}: largest of 32 tasks holds {max(sizes_) / sum(sizes_):.1%}")
        jobs = {
            "brute_force_firings": lambda: brute_force_firings(ev, cfg),
            "port_scan_firings": lambda: port_scan_firings(ev, cfg),
            "escalation_firings": lambda: escalation_firings(ev, cfg),
            "window_features": lambda: window_features(ev, cfg),
            "brute_force_alerts": lambda: rules.brute_force_alerts(ev, cfg),
            "port_scan_alerts": lambda: rules.port_scan_alerts(ev, cfg),
            "enrich_salted": lambda: enrich(ev, sec_intel(spark, sf), max_rows=0),
            "run_batch": lambda: run_batch(enrich(ev, sec_intel(spark, sf)), cfg).alerts,
        }
        for name, job in jobs.items():
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            print(f"{n} rows, {name}: {time.perf_counter() - start:.2f} s", flush=True)


if __name__ == "__main__":
    main()
