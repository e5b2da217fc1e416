"""Files along a curve: lookups give the rows of a plain filter and read few files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.sources import layout
from sparkwarden.sources.adapter import sec_events

FILES = 64


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    start = datetime(2024, 3, 1)
    i = F.col("id")
    mixed = F.abs(F.xxhash64("id"))
    events = spark.range(20_000).select(
        i.alias("event_seq"),
        (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=(mixed % 864_000).cast("decimal(18,6)"))).alias("event_ts"),
        # a third of the rows from one source, some from none
        F.when(i % 3 == 0, "10.0.0.1").when(i % 50 == 1, None).otherwise(F.concat(F.lit("10.1.0."), mixed % 400)).alias("source_ip"),
        F.concat(F.lit("ACTION_"), F.abs(F.hash("id")) % 6).alias("action"),
    )
    path = str(tmp_path_factory.mktemp("layout"))
    layout.write_layout(events, path, "first", FILES)
    return events, path, start


def lookups(start):
    return {
        "source": {"source_ip": "10.1.0.77"},
        "hot source in a day": {"source_ip": "10.0.0.1", "since": start + timedelta(days=4), "until": start + timedelta(days=5)},
        "time": {"since": start + timedelta(days=6), "until": start + timedelta(days=6, hours=12)},
        "action": {"action": "ACTION_3"},
        "none": {"source_ip": "192.168.0.1", "action": "ACTION_9"},
    }


def test_lookups_equal_a_filter_and_read_few_files(spark, stored):
    events, path, start = stored
    total = layout.listed_files(spark, path).count()
    assert total > FILES // 2
    for name, wanted in lookups(start).items():
        plain = events
        for c in ("source_ip", "action"):
            if c in wanted:
                plain = plain.where(F.col(c) == wanted[c])
        if "since" in wanted:
            plain = plain.where(F.col("event_ts").between(F.lit(wanted["since"]), F.lit(wanted["until"])))
        got = layout.find_events(spark, path, events.schema, **wanted)
        assert sorted(r.event_seq for r in got.collect()) == sorted(r.event_seq for r in plain.collect()), name
        assert layout.matching_files(spark, path, **wanted).count() <= total * 0.45, name


def test_a_hot_source_is_spread_evenly(spark, stored):
    sizes = [r.n for r in layout.listed_files(spark, stored[1]).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / FILES


def test_a_load_is_written_once_and_unlisted_files_are_not_read(spark, stored, tmp_path):
    events, path, _ = stored
    layout.write_layout(events, path, "first", FILES)
    few = events.where("event_seq < 100").withColumn("event_seq", F.col("event_seq") + 50_000)
    few.write.parquet(f"{path}/data/load=broken")  # a load that broke off before it was listed
    assert layout.find_events(spark, path, events.schema).count() == 20_000
    layout.write_layout(few, path, "broken", 2)
    assert layout.find_events(spark, path, events.schema).count() == 20_100
    empty = str(tmp_path / "empty")
    layout.write_layout(events.limit(0), empty, "nothing", 4)
    assert layout.find_events(spark, empty, events.schema, source_ip="10.0.0.1").count() == 0


def test_nulls_everywhere(spark, tmp_path):
    events = spark.createDataFrame([(1, None, None, None), (2, None, "10.0.0.1", "A")], "event_seq long, event_ts timestamp, source_ip string, action string")
    layout.write_layout(events, str(tmp_path), "nulls", 2)
    assert [r.event_seq for r in layout.find_events(spark, str(tmp_path), events.schema, source_ip="10.0.0.1").collect()] == [2]
    assert layout.find_events(spark, str(tmp_path), events.schema).count() == 2


def test_driver_table(spark, sf_dir, tmp_path):
    events = sec_events(spark, sf_dir)
    layout.write_layout(events, str(tmp_path), "feed", 8)
    got = layout.find_events(spark, str(tmp_path), events.schema, action="FAILED_LOGIN")
    assert got.count() == events.where("action = 'FAILED_LOGIN'").count()
