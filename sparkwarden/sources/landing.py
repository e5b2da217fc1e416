"""Landing of text feeds: every line or entry gets a number that never changes.

A load stores the texts once, each with its file, the start of the file block it was read from, and its place in the task that
read it. Numbers are not in these rows: the load's manifest has one row per file block with the number of its first row, by
distributed prefix sums over the blocks in the order of file and place, beginning where the load before ended. So numbers are
dense, follow the order of loads, files and lines, and hold whatever the tasks were. A file that an earlier load has seen is
not landed again; one that has changed since is counted and left alone; an empty one is not seen before it holds something. A load
that broke off is repeated as a whole.

An envelope is landed as its entries, so that each entry has its number and there is no bound on their count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.operators.joins import BROADCAST_ROWS
from sparkwarden.operators.normalize import bulk_entries
from sparkwarden.plans.materialize import materialize
from sparkwarden.sources import readers
from sparkwarden.sources.loads import LoadStore

COMMIT = "first_seq bigint, n_rows bigint, n_files bigint"
_METADATA = {"file": "file_path", "block": "file_block_start", "ingested_at": "file_modification_time"}


def as_lines(text: DataFrame) -> DataFrame:
    """Each row is a raw line."""
    return text.withColumns({"kind": F.lit("line"), "reject_reason": F.lit(None).cast("string")})


def as_documents(text: DataFrame) -> DataFrame:
    """Each row is a JSON document."""
    return text.withColumns({"kind": F.lit("document"), "reject_reason": F.lit(None).cast("string")})


Entries = Callable[[DataFrame], DataFrame]


def landing_store(spark: SparkSession, path: str) -> LoadStore:
    return LoadStore(spark, path, COMMIT)


def with_origin(text: DataFrame) -> DataFrame:
    """Rows of a text reader, batch or stream, with the file and block they come from."""
    return text.select("value", *[F.col(f"_metadata.{m}").alias(n) for n, m in _METADATA.items()])


def running_totals(df: DataFrame, order: list[str], count: str, into: str = "before") -> DataFrame:
    """``df`` with the sum of ``count`` over all rows that come before by ``order``, which is unique.

    Rows are dealt to ranges; a range's own sums are a window over it, and the driver adds up one number per range.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(count).alias("n")).orderBy("_range").collect()
    starts, total = [], 0
    for r in sums:
        starts.append((r["_range"], total))
        total += r["n"]
    spark = df.sparkSession
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.broadcast(spark.createDataFrame(starts, "_range int, _start bigint"))
    summed = ranged.withColumn(into, F.coalesce(F.sum(count).over(within), F.lit(0))).join(offset, "_range")
    return summed.withColumn(into, (F.col(into) + F.col("_start")).cast("bigint")).drop("_range", "_start")


def land_rows(store: LoadStore, text: DataFrame, load: int, entries: Entries = as_lines) -> None:
    """Land rows of :func:`with_origin` as load number ``load``; a load that is committed already is left as it is."""
    last = store.last()
    if last is not None and last["load"] >= load:
        return
    rows = store.write(entries(text).withColumn("place", F.monotonically_increasing_id()), "rows", load)
    blocks = rows.groupBy("file", "block").agg(F.min("place").alias("first_place"), F.count("*").alias("n"))
    first = 0 if last is None else last["first_seq"] + last["n_rows"]
    totals = running_totals(blocks, ["file", "block"], "n")
    manifest = store.write(totals.select("file", "block", "first_place", "n", (F.col("before") + first).alias("first_seq")), "blocks", load)
    counted = manifest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("file").alias("files")).first()
    store.commit(load, first_seq=first, n_rows=counted["n"], n_files=counted["files"])


@dataclass(frozen=True)
class Landed:
    """What :func:`land` found: the load, or none if no file was new, and how many known files have changed since."""

    load: int | None
    n_files: int
    changed: int


def land(store: LoadStore, path: str, entries: Entries = as_lines) -> Landed:
    """Land the text files of ``path`` (a folder or pattern) that no load has seen yet."""
    spark = store.spark
    # only names and sizes are read here
    there = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    known, last, changed = store.read("files"), store.last(), 0
    if known is not None:
        same = known.select("file", F.struct("size", "modified").alias("was"))
        changed = there.join(same, "file").where(F.struct("size", "modified") != F.col("was")).count()
        there = there.join(known, "file", "left_anti")
    new = [r["file"] for r in there.select("file").collect()]  # as many as the reader itself lists
    if not new:
        return Landed(None, 0, changed)
    load = 0 if last is None else last["load"] + 1
    store.write(there, "files", load)
    text = with_origin(spark.read.text(path).where(F.col("_metadata.file_path").isin(new)))
    land_rows(store, text, load, entries)
    return Landed(load, len(new), changed)


def read_landed(store: LoadStore, load: int | None = None) -> DataFrame:
    """``event_seq, kind, value, reject_reason, ingested_at, file`` of all loads, or of one."""

    def rows(table: str) -> DataFrame:
        return store.read(table) if load is None else store.one(table, load).withColumn("load", F.lit(load))

    blocks = rows("blocks").select("load", "file", "block", "first_place", "first_seq")
    few = blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # otherwise a block is a bounded share of a file, and so no hot key
    found = rows("rows").join(F.broadcast(blocks) if few else blocks, ["load", "file", "block"])
    number = F.col("first_seq") + F.col("place") - F.col("first_place")
    return found.select(number.alias("event_seq"), "kind", "value", "reject_reason", "ingested_at", "file")


def landed_events(landed: DataFrame, year: int | None = None, kinds: tuple[str, ...] = ("line",)) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)`` of landed rows of the given kinds: ``line``, ``document``, or ``line`` and ``entry`` of envelopes."""
    found = []
    for kind in kinds:
        some = landed.where(F.col("kind") == kind).select("event_seq", "value", "ingested_at")
        if kind == "line":
            found.append(readers.normalize_lines(some.withColumnRenamed("value", "line"), year))
        else:
            found.append(readers.normalize_docs(some, year, reroute_raw=kind == "document"))
    rejects = landed.where("kind = 'reject'").select("event_seq", F.col("value").alias("raw"), "reject_reason", "ingested_at")
    events = found[0][0]
    for more, _ in found[1:]:
        events = events.unionByName(more)
    for _, bad in found:
        rejects = rejects.unionByName(bad)
    return events, rejects

