"""Plans and the driver contract: pruning, pushdown, join choice, reuse, no all-pairs joins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkwarden.operators.brute_force import brute_force_firings
from sparkwarden.operators.enrich import enrich
from sparkwarden.operators.features import window_features
from sparkwarden.plans import catalog as c
from sparkwarden.sources import tables
from sparkwarden.sources.adapter import sec_events, sec_intel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_join_follows_the_size_of_the_feed(spark, sf_dir):
    small = plan(enrich(sec_events(spark, sf_dir), sec_intel(spark, sf_dir)))
    assert "BroadcastHashJoin" in small and "Exchange hashpartitioning" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(enrich(sec_events(spark, sf_dir), sec_intel(spark, sf_dir), max_rows=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "SortMergeJoin" in large and "_salt" in large


def test_rules_read_few_columns_and_share_the_candidates(spark, sf_dir):
    p = final_plan(brute_force_firings(sec_events(spark, sf_dir), c.CFG))
    assert "value:double" not in p and "props:string" not in p
    assert "ReusedExchange" in p or "Reused" in p


def test_features_take_one_shuffle(spark, sf_dir):
    p = plan(window_features(sec_events(spark, sf_dir), c.CFG))
    assert p.count("Exchange hashpartitioning") == 1


def test_event_store_prunes_days_and_pushes_sources(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(sec_events(spark, sf_dir), path, files_per_day=1)
    df = tables.read_events(spark, path).filter(
        (F.col("event_date") == F.lit("2024-01-10").cast("date")) & (F.col("source_ip") == "10.0.0.7")
    ).select("event_seq")
    p = plan(df)
    assert "EqualTo(source_ip,10.0.0.7)" in p and "PartitionFilters: [isnotnull(event_date" in p
    assert "ReadSchema: struct<event_seq:bigint,source_ip:string>" in p


@pytest.mark.parametrize("name", ["o26b_detect_all", "o21_port_scan_evidence", "o32_first_blocks", "o36_feature_matrix", "o24_escalation_two_failures"])
def test_no_all_pairs(spark, sf_dir, name):
    p = plan(c.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
    df = entry.entry(spark)
    assert df.count() > 0 and "source_ip" in df.columns


@pytest.mark.parametrize("name", ["o11_normalize_parsed", "o22_brute_force_alerts", "o23_port_scan_alerts", "o35_distinct_ports", "batch_mitigations"])
def test_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "supplier", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cur.description)
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    order = [[d[0] for d in cur.description].index(n) for n in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in columns]).collect()) == want
