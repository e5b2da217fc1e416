"""Conversation structure repair by Knuth's lightest derivations.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Its rows are repaired by edits: keep a row (K, free),
give it the role that the place needs (R, 1), delete it (D, 2), or insert an empty turn anywhere (I, 5). Blank rows and
repetitions of an earlier row must go; a truncated row that stays costs 5 more.

The repair is a weighted deduction. An item ``[i, q]`` says that the first ``i`` rows are read and the written roles led the
grammar's automaton to state ``q``; an edit deduces an item from another one, and the goal is deduced from an accepting
item behind the last row. An item's value is ``(cost, audit)``, the audit being the initials of its edits. Every deduction
makes its value larger, and no smaller value of an item ever gives a larger one of the next: two audits of one item with one
cost have read the same rows, so neither is a proper beginning of the other. Such functions are superior in Knuth's sense, so
items leave the agenda in the order of their least values, and the first goal that leaves it is the cheapest repair, ties
having the ASCII-least audit.

A long conversation is deduced in segments: the values of the (four at most) items between two segments are the axioms of
the next one. What their audits have in common at the front is settled and put aside, so that a task holds one segment, one
character for each row read, and the texts of one Arrow batch, whatever the length of a conversation. Rows are dealt by
conversation twice: without texts for the deduction, with texts to carry it out.

Rows stand in the order of turn (nulls first), role, the text's first 64 characters, and its digest; equal rows are repeated
rows. Null roles and texts are one space. Rows with a null ``conv_id`` are one conversation. An empty table gives no row. Other
columns are dropped, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are deduced at once.
SEGMENT = 128
#: Characters of a text that order rows of one turn before its digest does.
HEAD = 64
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
# states by the last role written: none, system, user, assistant
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPTING, _GOAL = (0, 3), 4
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL_PAIRS = {"su", "ua", "au"}

Axiom = tuple[int, int, str]  # state, cost, audit


def needed(state: int) -> str:
    """The initial of the role that may be written in ``state`` by an edit."""
    return "a" if state == 2 else "u"


@functools.lru_cache(1 << 12)
def lightest(rows: str, axioms: tuple[Axiom, ...], last: bool) -> tuple[Axiom, ...]:
    """The least values of the items behind ``rows``, or of the goal alone if these are the last rows.

    A row is two characters: the initial of its role, and its fault.
    """
    agenda = [(cost, audit, 0, state) for state, cost, audit in axioms]
    heapify(agenda)
    final: set[tuple[int, int]] = set()
    found: list[Axiom] = []
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if state == _GOAL:
            return ((state, cost, audit),)
        write = needed(state)
        if 2 * i == len(rows):
            if not last:
                found.append((state, cost, audit))
            elif state in _ACCEPTING:
                heappush(agenda, (cost, audit, i, _GOAL))
        else:
            initial, fault = rows[2 * i], int(rows[2 * i + 1])
            heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
            if fault in (SOUND, TRUNCATED):
                stays = cost + (TRUNCATED_STAYS if fault == TRUNCATED else 0)
                heappush(agenda, (stays + REROLE, audit + "R", i + 1, _NEXT[state, write]))
                if (state, initial) in _NEXT:
                    heappush(agenda, (stays, audit + "K", i + 1, _NEXT[state, initial]))
        heappush(agenda, (cost + INSERT, audit + "I", i, _NEXT[state, write]))
    return tuple(found)


class Deduction:
    """The repair of one conversation whose rows come one after the other."""

    def __init__(self):
        self.rows: list[str] = []
        self.axioms: tuple[Axiom, ...] = ((0, 0, ""),)
        self.cost = 0
        self.settled: list[str] = []
        self.counts = [0, 0, 0, 0]
        self.illegal = 0
        self.before: str | None = None
        self.turns: tuple | None = None  # least, largest, distinct ones

    def read(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in _LEGAL_PAIRS
        self.before = initial
        if turn is not None:  # rising
            least, most, n = self.turns or (turn, None, 0)
            self.turns = (least, turn, n + (turn != most))
        self.rows.append(f"{initial if initial in ('s', 'u', 'a') else '-'}{fault}")
        if len(self.rows) == SEGMENT:
            self._deduce(False)

    def _deduce(self, last: bool) -> None:
        found = lightest("".join(self.rows), self.axioms, last)
        self.rows.clear()
        front, spent = commonprefix([audit for _, _, audit in found]), min(cost for _, cost, _ in found)
        self.settled.append(front)
        self.cost += spent
        self.axioms = tuple((state, cost - spent, audit[len(front) :]) for state, cost, audit in found)

    def result(self) -> tuple:
        """``(gaps, blank, duplicate, truncated, illegal, cost, audit)``"""
        self._deduce(True)
        least, most, n = self.turns or (0, -1, 0)
        return most - least + 1 - n, *self.counts[1:], self.illegal, self.cost, "".join(self.settled)


def carry_out(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of the turns that stay or come in; ``rows`` are ``(role, text)``, read one by one."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else needed(state)
        state = _NEXT[state, initial]
        yield edit, role if edit == "K" else _ROLES[initial], text


def _prepared(rows: DataFrame, left_out: str | None) -> DataFrame:
    said = F.coalesce(F.col("text"), F.lit(" "))
    out = F.coalesce(F.col(left_out), F.lit(False)) if left_out else F.lit(False)
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), said.alias("text"), out.alias("out")).select(
        "*", F.substring("text", 1, HEAD).alias("head"), F.sha2("text", 256).alias("digest")
    )


_ORDER = ["turn", "role", "head", "digest"]


def repairs(rows: DataFrame, left_out: str | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for each conversation of ``rows``.

    Rows where the boolean column ``left_out`` is true aren't there, but their conversation is.
    """
    same = Window.partitionBy("conv_id", "out", "role", "digest").orderBy("turn")
    seen = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(SOUND)
    )
    # what a text is found to be is settled before rows move, so that texts stay where they are
    narrow = _prepared(rows, left_out).withColumn("seen", seen).drop("text").repartition("conv_id")
    repeated = (F.row_number().over(same) > 1) & (F.col("seen") != BLANK)
    marked = narrow.withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("seen")))
    kind = rows.schema["conv_id"].dataType
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType(
        [T.StructField("conv_id", kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("audit", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        now, id_type = Deduction(), pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            done = []
            for conv, turn, role, fault, out in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held is not None and held[0] != conv:
                    done.append((held[0], *now.result()))
                    now = Deduction()
                held = (conv,)
                if not out:
                    now.read(turn, role, fault)
            if done:
                yield _batch(done, schema.names, id_type)
        if held is not None:
            yield _batch([(held[0], *now.result())], schema.names, id_type)

    columns = ["conv_id", "turn", "initial", "fault", "out"]
    ordered = marked.withColumn("initial", F.substring("role", 1, 1)).sortWithinPartitions("conv_id", *_ORDER)
    return ordered.select(columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.string() if n in ("audit", "edit", "role", "text", "repaired_sha256") else pa.int64() for n in names[1:]]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repaired(rows: DataFrame, found: DataFrame, left_out: str | None = None) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns after the edits of ``found(conv_id, audit)``.

    The turns of a conversation lie in one partition in the order of ``place``, which counts from 0.
    """
    texts = _prepared(rows, left_out).where("NOT out").select("conv_id", *_ORDER, "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in (*_ORDER, "text")], "audit")
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", kind), T.StructField("place", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: pa.DataType = pa.int64()

        def lines() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True)

        source = lines()
        done: list[tuple] = []
        chars = 0
        for conv, _, _, audit in source:  # the row with the audit; the others are read below
            turns = ((role, text) for _, role, text, _ in source)
            for place, turn in enumerate(carry_out(audit, turns)):
                done.append((conv, place, *turn))
                chars += len(turn[2])
                if chars > 1 << 21 or len(done) >= 1000:
                    yield _batch(done, schema.names, id_type)
                    done, chars = [], 0
        if done:
            yield _batch(done, schema.names, id_type)

    both = texts.unionByName(heads).repartition("conv_id").withColumn("behind", F.col("audit").isNull())
    ordered = both.sortWithinPartitions("conv_id", "behind", *_ORDER)
    return ordered.select("conv_id", "role", "text", "audit").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines, for conversations as ``repaired`` gives them."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        now = hashlib.sha256()
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held is not None and held[0] == conv:
                    now.update(b"\n")
                else:
                    if held is not None:
                        done.append((held[0], now.hexdigest()))
                    held, now = (conv,), hashlib.sha256()
                now.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, schema.names, id_type)
        if held is not None:
            yield _batch([(held[0], now.hexdigest())], schema.names, id_type)

    return turns.select("conv_id", "role", "text").mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """The rows with a few faults put in by a hash of conversation and turn; ``dropped`` marks rows that are gone."""

    def word(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    h = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.col("h") == 0, F.when(F.col("h") == 3, 2).otherwise(1))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("dropped"))


#: Unsigned crc32 of an ASCII text column ``k`` by a table that the query makes itself.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) t(i)))"""
CRC = (
    "xor(list_reduce(list_transform(string_split({k}, ''), lambda c: ascii(c)::BIGINT), "
    "lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
)


def sql() -> str:
    """The damage and the repair as a fold over each conversation's rows; the value of an item is a struct of cost and audit."""

    def after(state: str, cost: str, edit: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} ELSE {{'c': 1000000000, 'a': ''}} END"

    def least(*values: str) -> str:
        return f"list_min([{', '.join(values)}])"

    stay, more = "r.f IN (0, 3)", "CASE r.f WHEN 3 THEN 5 ELSE 0 END"

    def written(state: str, initial: str) -> list[str]:
        out = [after(state, more, "K", f"{stay} AND r.i = '{initial}'")]
        return out if initial == "s" else [*out, after(state, f"1 + {more}", "R", stay)]

    read = {
        "n0": after("s.n0", "2", "D"),
        "n1": least(after("s.n1", "2", "D"), *written("s.n0", "s")),
        "n2": least(after("s.n2", "2", "D"), *written("s.n0", "u"), *written("s.n1", "u"), *written("s.n3", "u")),
        "n3": least(after("s.n3", "2", "D"), *written("s.n2", "a")),
    }
    rows_read = "{" + ", ".join(f"'{k}': {v}" for k, v in read.items()) + "}"
    # inserted turns: a user behind any other state, then an assistant, then a user again
    user = least("m.n2", *(after(f"m.{n}", "5", "I") for n in ("n0", "n1", "n3")))
    with_user = f"list_transform([{rows_read}], lambda m: {{'n0': m.n0, 'n1': m.n1, 'n2': {user}, 'n3': m.n3}})"
    both = f"list_transform({with_user}, lambda m: {{'n0': m.n0, 'n1': m.n1, 'n2': m.n2, 'n3': {least('m.n3', after('m.n2', '5', 'I'))}}})"
    again = f"list_transform({both}, lambda m: {{'n0': m.n0, 'n1': m.n1, 'n2': {user}, 'n3': m.n3}})[1]"
    none = "{'c': 1000000000, 'a': ''}"
    start = f"{{'n0': {{'c': 0, 'a': ''}}, 'n1': {none}, 'n2': {{'c': 5, 'a': 'I'}}, 'n3': {{'c': 10, 'a': 'II'}}}}"
    return f"""
WITH {CRC_TABLE},
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT src.*, {CRC.format(k="k")} % 20 AS h FROM src, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {HEAD}), sha256(text)) AS pos FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS f
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': i, 'f': f}} ORDER BY pos) AS rows, list({{'role': role, 'text': text}} ORDER BY pos) AS texts
  FROM judged GROUP BY conv_id),
walked AS (SELECT *, list_reduce(rows, lambda s, r: {again}, {start}) AS s FROM counted),
best AS (SELECT *, least(s.n0, s.n3) AS b FROM walked),
edits AS (SELECT conv_id, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS p, texts FROM best),
lines AS (
  SELECT conv_id, p, audit[p] AS e, texts[length(replace(left(audit, p), 'I', ''))] AS t, length(replace(left(audit, p), 'D', '')) AS n
  FROM edits),
kinds AS (
  SELECT conv_id, bool_or(n = 1 AND e = 'K' AND left(t.role, 1) = 's') AS system FROM lines WHERE e <> 'D' GROUP BY conv_id),
written AS (
  SELECT lines.conv_id, string_agg(
      CASE WHEN e = 'K' THEN t.role WHEN (n + system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN e = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p) AS said
  FROM lines JOIN kinds ON lines.conv_id IS NOT DISTINCT FROM kinds.conv_id WHERE e <> 'D' GROUP BY lines.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN written ON written.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
