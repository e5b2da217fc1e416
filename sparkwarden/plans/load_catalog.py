"""Named queries of feeds that come in loads: landing, the incremental job, and streams that end in alerts."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from sparkwarden.operators.enrich import enrich
from sparkwarden.plans import catalog as c
from sparkwarden.plans import sql
from sparkwarden.plans.catalog import CFG, YEAR, query, us
from sparkwarden.plans.incremental import detect_load, detect_store, finish, load_summary
from sparkwarden.sources import landing, layout, readers
from sparkwarden.sources.adapter import as_sec_events, document_lines, sec_events, sec_intel
from sparkwarden.streaming import flows
from sparkwarden.streaming.alerts import alert_sink, feed_sink, stream_texts

_LOADS = 3


def _third(spark, sf, column: str = "event_seq"):
    """Number of the load that an event belongs to: thirds of the feed by number."""
    low, high = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("event_id"), F.max("event_id")).first()
    return F.floor((F.col(column) - (low or 0)) * _LOADS / ((high or 0) - (low or 0) + 1)).cast("int")


@query(
    "s01_land_loads",
    sql.with_ctes(
        """SELECT row_number() OVER (ORDER BY event_seq) - 1 AS event_seq, event_seq AS source_seq,
  clock || ' ' || hostname || ' ' || service || '[' || pid || ']: ' || body AS line FROM ev JOIN body USING (event_seq)"""
    ),
)
def s01_loads(spark, sf):
    """Lines that come in several loads, each offered twice: numbers are those of one load of everything."""
    path, store = c.new_path(spark, "feed"), landing.landing_store(spark, c.new_path(spark, "landed"))
    lines = sec_events(spark, sf).select("event_seq", "raw", _third(spark, sf).alias("part"))
    for part in range(_LOADS):
        some = lines.where(F.col("part") == part).repartitionByRange(4, "event_seq").sortWithinPartitions("event_seq")
        some.select("raw").write.text(f"{path}/day={part}")
        for _ in range(2):
            landing.land(store, f"{path}/*")
    landed = landing.read_landed(store)
    number = F.regexp_extract("value", r"\[(\d+)\]: ", 1).cast("bigint")
    return landed.select("event_seq", number.alias("source_seq"), F.col("value").alias("line"))


@query(
    "s03_land_bulk",
    sql.with_ctes(
        """SELECT row_number() OVER (ORDER BY batch, CASE WHEN action IN ('FAILED_LOGIN', 'SUDO_COMMAND') THEN 0 ELSE 1 END, event_seq) - 1
    AS event_seq, action, source_ip, ts_us // 1000000 * 1000000 AS ts_us
FROM (SELECT *, min(event_seq) OVER (PARTITION BY coalesce(usr, source_ip), CAST(wall AS DATE)) AS batch FROM ev)"""
    ),
)
def s03_bulk(spark, sf):
    """Envelopes in more files than the numbers of a reader could hold apart, landed entry by entry."""
    path, store = c.new_path(spark, "envelopes"), landing.landing_store(spark, c.new_path(spark, "landed"))
    envelopes = c.bulk_envelopes(spark, sf).repartitionByRange(80, "batch_seq").sortWithinPartitions("batch_seq")
    envelopes.select("value").write.text(path)
    landing.land(store, path, landing.bulk_entries)
    events, _ = landing.landed_events(landing.read_landed(store), YEAR, ("line", "entry"))
    return events.select("event_seq", "action", "source_ip", us())


#: How far events are out of order in the feed of the incremental queries.
_DELAY_S = 6 * c.HOUR


def incremental_store(spark, sf):
    """The feed out of order, cut into loads where it arrives."""
    store = detect_store(spark, c.new_path(spark, "detect"))
    events = enrich(sec_events(spark, sf), sec_intel(spark, sf))
    arrival = F.unix_micros("event_ts") + F.pmod(F.xxhash64("event_seq"), F.lit(_DELAY_S * 1_000_000))
    low, high = events.agg(F.min(F.unix_micros("event_ts")), F.max(F.unix_micros("event_ts"))).first()
    part = F.floor((arrival - (low or 0)) * _LOADS / ((high or 0) - (low or 0) + 1))
    for n in range(_LOADS):
        some = events.where(F.least(part, F.lit(_LOADS - 1)) == n)
        for _ in range(1 + (n == 1)):  # a load that is offered again adds nothing
            detect_load(store, some, n, CFG, delay_s=_DELAY_S)
    finish(store, cfg=CFG, delay_s=_DELAY_S)
    return store


@query("batch_incremental_alerts", sql.with_ctes(c._ALERT_SQL, *c._KEPT_ALERTS))
def incremental_alerts(spark, sf):
    """Loads that go on where the last one ended give the alerts of one load."""
    return c.alert_view(incremental_store(spark, sf).read("alerts"))


#: Rows of a file of the streamed feed, so that a large micro-batch is read by many tasks.
_FILE_ROWS = 100_000


def streamed_store(spark, sf):
    """The feed as a stream in two deliveries of files, each one micro-batch, into alerts and what follows from them."""
    source, path = c.new_path(spark, "event-files"), c.new_path(spark, "detect")
    raw = spark.read.parquet(f"{sf}/events.parquet")
    half = F.floor(_third(spark, sf, "event_id") * 2 / _LOADS)
    settings = {"cfg": CFG, "delay_s": c.HOUR, "destinations": ("pager", "mail")}
    sink = alert_sink(path, lambda s: sec_intel(s, sf), **settings)
    for part in range(2):  # a stream takes all files there are, and goes on with those that come later
        raw.where(half == part).write.option("maxRecordsPerFile", _FILE_ROWS).mode("append").parquet(source)
        stream = as_sec_events(readers.stream_events(spark, source, raw.schema, max_files=2**31 - 1))
        flows.run_available(stream, f"{path}-checkpoint", sink=sink)
    store = detect_store(spark, path)
    finish(store, **settings)
    return store


@query("t10_stream_alerts", sql.with_ctes(c._ALERT_SQL, *c._KEPT_ALERTS))
def t10(spark, sf):
    return c.alert_view(streamed_store(spark, sf).read("alerts"))


@query(
    "t11_stream_responses",
    sql.with_ctes(
        f"""SELECT triggering_alert_id AS alert_id, action AS kind, target FROM ({c._MITIGATION_SQL})
UNION ALL SELECT sha256(rule_name || '|' || key || '|' || CAST(created_us AS BIGINT) || '|' || trigger_seq), 'NOTIFY', destination
FROM alerts, (VALUES ('pager'), ('mail')) d(destination)""",
        *c._KEPT_ALERTS,
    ),
)
def t11(spark, sf):
    """Mitigations and notifications of the streamed alerts."""
    store = streamed_store(spark, sf)
    done = store.read("mitigations").select(F.col("triggering_alert_id").alias("alert_id"), F.col("action").alias("kind"), "target")
    told = store.read("outbox").select("alert_id", F.lit("NOTIFY").alias("kind"), F.col("destination").alias("target"))
    return done.unionByName(told)


@query(
    "t12_stream_feed_summary",
    """WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
trimmed AS (SELECT trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)) AS line FROM lines)
SELECT CAST((SELECT count(*) FROM events) + (SELECT count(*) FROM lines) AS BIGINT) AS landed, CAST((SELECT count(*) FROM events) AS BIGINT) AS arrived,
  CAST((SELECT count(*) FROM trimmed WHERE line = '') AS BIGINT) AS empty, CAST((SELECT count(*) FROM trimmed WHERE line <> '') AS BIGINT) AS no_header""",
)
def t12(spark, sf):
    """A stream of raw lines, many of them unreadable: the sums of its micro-batches' counts."""
    source, path = c.new_path(spark, "line-files"), c.new_path(spark, "feed")
    # a text file ends lines at other breaks too; what is no event stays unreadable without them
    unreadable = document_lines(spark, sf).select(F.regexp_replace("line", r"\r", " ").alias("raw"))
    sec_events(spark, sf).select("raw").unionByName(unreadable).write.text(source)
    sink = feed_sink(path, lambda s: sec_intel(s, sf), year=YEAR, cfg=CFG, delay_s=c.HOUR)
    flows.run_available(stream_texts(spark, source), f"{path}-checkpoint", sink=sink)
    landed = landing.landing_store(spark, f"{path}/landing").commits().agg(F.sum("n_rows").alias("landed"))
    arrived = load_summary(detect_store(spark, path)).agg(F.sum("arrived").alias("arrived"))
    reasons = spark.read.parquet(f"{path}/rejects").agg(*[F.count_if(F.col("reject_reason") == r).alias(r) for r in ("empty", "no_header")])
    return landed.join(F.broadcast(arrived)).join(F.broadcast(reasons))


@query(
    "s09_layout_lookups",
    sql.with_ctes(
        """SELECT 'source' AS lookup, event_seq FROM ev WHERE source_ip = (
  SELECT source_ip FROM ev WHERE source_ip IS NOT NULL GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 1)
UNION ALL SELECT 'action', event_seq FROM ev WHERE action = 'FAILED_LOGIN'
UNION ALL SELECT 'time', event_seq FROM ev, (SELECT min(ts_us) AS low, max(ts_us) AS high FROM ev)
WHERE ts_us BETWEEN low + (high - low) * 9 // 20 AND low + (high - low) * 11 // 20"""
    ),
)
def s09_layout(spark, sf):
    """Files along a curve over time, source and action: the busiest source, one action, and the middle tenth of the time."""
    events, path = sec_events(spark, sf), c.new_path(spark, "layout")
    layout.write_layout(events, path, "feed", 64)
    busy = events.where("source_ip IS NOT NULL").groupBy("source_ip").agg(F.count("*").alias("n"))
    busiest = busy.orderBy(F.desc("n"), "source_ip").first()
    low, high = (x or 0 for x in events.agg(F.min(F.unix_micros("event_ts")), F.max(F.unix_micros("event_ts"))).first())
    since, until = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=low + (high - low) * k // 20) for k in (9, 11))
    wanted = {
        "source": {"source_ip": busiest.source_ip if busiest else ""},
        "action": {"action": "FAILED_LOGIN"},
        "time": {"since": since, "until": until},
    }
    found = [
        layout.find_events(spark, path, events.schema, **w).select(F.lit(name).alias("lookup"), "event_seq")
        for name, w in wanted.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])
