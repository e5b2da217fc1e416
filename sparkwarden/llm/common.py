"""What several operators of this folder share: table reads, cut points, samples of labels, columns added by Arrow functions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.plans.materialize import shared_dir

#: Rows of texts in one Arrow batch.
BATCH_ROWS = 1000
#: A key with more than this share of the rows is looked up by broadcast; there are at most as many such keys.
HEAVY_SHARE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the folder all executors share, and read back from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def lookup(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``found``, in which ``key`` is unique; a key that very many rows hold is broadcast.

    ``rows`` is read several times, so it is to be a written table.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("rows_of_key"))
    # by the counts themselves there are fewer such keys than HEAVY_SHARE
    heavy = cut(counts.where(F.col("rows_of_key") * HEAVY_SHARE > max(rows.count(), HEAVY_SHARE)).select(key).where(F.col(key).isNotNull()))
    some = F.broadcast(found.join(F.broadcast(heavy), key, "left_semi"))
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(found, key, "left")
    return rows.join(F.broadcast(heavy), key, "left_semi").join(some, key, "left").unionByName(rest)


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers live on, and allocators keep an earlier stage's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by five. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, y, turn)``: at most ``most`` labelled ids outside the held-out fold, taken and ordered by hash.

    An id that is labelled twice counts once, as 1 if any row says 1; null ids and null labels are left out. The result
    has at most ``most`` rows of three numbers, so that it may be broadcast.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(most)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put on until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` and new columns that ``fn`` makes from each Arrow batch; older columns of the same names give way."""
    new = {f.name for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = fn(batch)
            names = batch.schema.names
            keep = [i for i, n in enumerate(names) if n not in new]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + added, names=[names[i] for i in keep] + [f.name for f in fields]
            )

    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + fields)
    return df.mapInArrow(run, schema)
