"""Joins of an event table with a small or a large lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a lookup table that are sent to every task at most; about 100 bytes each.
BROADCAST_ROWS = 200_000
# The same for a table that is looked up: beyond, all facts are shuffled.
LOOKUP_ROWS = 500_000


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str = "event_seq",
    max_rows: int = LOOKUP_ROWS,
    salts: int = 32,
) -> DataFrame:
    """``facts`` left-joined with ``dim`` (one row per ``key``).

    ``dim`` is counted up to ``max_rows`` and broadcast only if it is no larger. Otherwise both sides are shuffled on
    ``(key, salt)``: each fact takes one of ``salts`` salts by its ``spread`` column and each dim row is repeated for
    all, so a key with a third of all facts is shared by ``salts`` tasks, and so are the facts without a key.
    """
    if dim.limit(max_rows + 1).count() <= max_rows:
        return facts.join(F.broadcast(dim), key, "left")
    return salted_join(facts, dim, key, spread, salts)


def salted_join(facts: DataFrame, dim: DataFrame, key: str, spread: str = "event_seq", salts: int = 32) -> DataFrame:
    """The shuffled form of :func:`lookup_join`, which needs no look at ``dim``. Spark's guess of a size takes no account of the
    repeated rows; they are never to be broadcast."""
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [key, "_salt"], "left").drop("_salt")
