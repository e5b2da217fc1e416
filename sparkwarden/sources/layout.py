"""Event files laid out for lookups by time, by source and by action at once.

Each of the three columns becomes a rank of ``2**BITS`` ranges with about as many rows each; the bits of the three ranks,
interleaved, are a place on a space-filling curve. Files are ranges of that curve, so a file is narrow in every column, not
in the first one only. A busy source is cut by time and action like all others, and rows of one place by a hash.

``files`` lists each file with the least and greatest value of each column; a lookup reads the files that may hold its
rows. It is written last, under the load's own name: a load that broke off has no entry and is not read, one that runs
again under the same name adds nothing. Sources and actions are ordered by hash, as only equality is asked of them. Null
sources are rank 0 and are found by no source; a null time or action likewise.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 5
#: Relative error of the ranges' bounds is 1 / ACCURACY.
ACCURACY = 10_000
_VALUES = {"t": "unix_micros(event_ts)", "s": "if(source_ip IS NULL, null, xxhash64(source_ip))", "a": "if(action IS NULL, null, xxhash64(action))"}
_LISTED = ", ".join(f"least_{c} long, most_{c} long" for c in _VALUES)
_FILES_DDL = f"file string, n long, {_LISTED}, load string"


def _ranks(events: DataFrame) -> dict[str, Column]:
    """Rank of each column's value among bounds that part the rows evenly; one row of bounds comes to the driver."""
    points = ", ".join(f"{i / (1 << BITS)!r}D" for i in range(1, 1 << BITS))
    wanted = [f"percentile_approx({value}, array({points}), {ACCURACY}) AS {c}" for c, value in _VALUES.items()]
    bounds = events.selectExpr(*wanted).first()

    def rank(c: str) -> Column:
        # a value that many rows hold is several bounds; they stay, so that it keeps its share of the ranks
        held = F.array(*[F.lit(b) for b in bounds[c] or []]).cast("array<bigint>")
        x = F.expr(_VALUES[c])
        return F.when(x.isNull(), 0).otherwise(F.size(F.filter(held, lambda b: b <= x)))

    return {c: rank(c) for c in _VALUES}


def curve_place(ranks: dict[str, Column]) -> Column:
    """The ranks' bits in turn, highest first, as one number."""
    place = F.lit(0).cast("bigint")
    for i in range(BITS):
        for j, rank in enumerate(reversed(list(ranks.values()))):
            bit = F.shiftright(rank.cast("bigint"), i).bitwiseAND(F.lit(1))
            place = place.bitwiseOR(F.shiftleft(bit, i * len(ranks) + j))
    return place


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, n``, bounds and ``load`` of every file of finished loads; none if there is no load yet."""
    try:
        return spark.read.schema(_FILES_DDL).parquet(f"{path}/files")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILES_DDL)


def write_layout(events: DataFrame, path: str, load: str, files: int) -> None:
    """Write ``events`` as about ``files`` files along the curve and list them, unless ``load`` is listed already."""
    spark = events.sparkSession
    if not listed_files(spark, path).where(F.col("load") == load).isEmpty():
        return
    placed = events.withColumn("_place", curve_place(_ranks(events)))
    ranged = placed.repartitionByRange(files, F.col("_place"), F.xxhash64("event_seq")).sortWithinPartitions("_place", "event_ts")
    data = f"{path}/data/load={load}"
    ranged.drop("_place").write.mode("overwrite").parquet(data)
    ends = [F.expr(f"{f}({value})").alias(f"{name}_{c}") for c, value in _VALUES.items() for f, name in (("min", "least"), ("max", "most"))]
    stored = spark.read.schema(events.schema).parquet(data)
    listing = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *ends)
    listing.withColumn("load", F.lit(load)).write.mode("append").parquet(f"{path}/files")


def matching_files(
    spark: SparkSession,
    path: str,
    source_ip: str | None = None,
    action: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """The listed files that may hold rows of the lookup."""
    found = listed_files(spark, path)
    for c, wanted in (("s", source_ip), ("a", action)):
        if wanted is not None:
            found = found.where(F.xxhash64(F.lit(wanted)).between(F.col(f"least_{c}"), F.col(f"most_{c}")))
    if since is not None:
        found = found.where(F.col("most_t") >= F.unix_micros(F.lit(since)))
    if until is not None:
        found = found.where(F.col("least_t") <= F.unix_micros(F.lit(until)))
    return found


def find_events(spark: SparkSession, path: str, schema, source_ip=None, action=None, since=None, until=None) -> DataFrame:
    """Events of a source, of an action and from ``since`` to ``until``, both included; what is None is not asked for.

    Only names of files come to the driver, which plans the scan by them anyway.
    """
    names = [r.file for r in matching_files(spark, path, source_ip, action, since, until).select("file").collect()]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    for c, wanted in (("source_ip", source_ip), ("action", action)):
        if wanted is not None:
            rows = rows.where(F.col(c) == wanted)
    if since is not None:
        rows = rows.where(F.col("event_ts") >= F.lit(since))
    return rows if until is None else rows.where(F.col("event_ts") <= F.lit(until))
