"""The corpus pipeline: five stages, each written and read again, from ``documents`` to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import line_dedup, packing, quality, simhash, toxicity
from sparkwarden.llm.common import cut, free_name, table
from sparkwarden.llm.queries import tokenizer_file

#: From this score on a document is rejected as toxic, and below this one as of low quality.
TOXIC, GOOD = 0.5, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return toxicity.score(docs, model, into=name).where(F.col(name) < TOXIC).select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model.labels is None:  # nothing to judge by
        return docs
    name = free_name(docs, "score")
    return quality.score(docs, model, into=name).where(F.col(name) >= GOOD).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, report=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, most_bits=2)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack_documents),
]
#: Learned scores, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
