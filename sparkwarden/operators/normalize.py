"""Raw lines and JSON documents to the normalized event table, with rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.parse import header_fields, message_columns, message_groups, strip
from sparkwarden.functions.scalar import action_severity, iso_ts, iso_wall, syslog_ts, utc_wall
from sparkwarden.schema import EVENT_COLUMNS


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_header(lines: DataFrame) -> DataFrame:
    """Add ``clock, hostname, service, pid, message`` and ``reject_reason`` (``empty``, ``no_header`` or null).

    ``lines`` has a STRING column ``line``; its other columns pass through.
    """
    passed = [c for c in lines.columns if c != "line"]
    return (
        lines.withColumn("line", strip(F.col("line")))
        .withColumn("_h", header_fields(F.col("line")))
        .selectExpr(
            *passed,
            "line",
            "CASE WHEN line IS NULL OR line = '' THEN 'empty' WHEN size(_h) != 5 THEN 'no_header' END AS reject_reason",
            "if(size(_h) = 5, _h[0], null) AS clock",
            *[f"nullif(try_element_at(_h, {i}), '') AS {n}" for i, n in enumerate(("hostname", "service", "pid", "message"), 2)],
        )
    )


def classify(parsed: DataFrame) -> DataFrame:
    """Add ``action, user, source_ip, destination_port``; a sudo row's message becomes its command."""
    found = message_columns("_m", "message")
    passed = [c for c in parsed.columns if c not in found]
    return parsed.withColumn("_m", message_groups(F.col("message"))).selectExpr(
        *passed, *[f"{text} AS {name}" for name, text in found.items()]
    )


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` by ``reject_reason``."""
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason"), df.filter(
        F.col("reject_reason").isNotNull()
    )


def parse_syslog(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(parsed, rejects)`` of raw lines ``event_seq, line, ingested_at``; a bad line never fails the job.

    The parsed rows come out of a generator that yields one row or none per line. A filter on the header, or a later one
    on the action, would be moved below the parsing and repeat its patterns there.
    """
    header = {n: f"nullif(_h[{i}], '')" for i, n in enumerate(("clock", "hostname", "service", "pid"))}
    fields = header | message_columns("_m", "_h[4]")
    row = ", ".join(f"{text} AS {name}" for name, text in fields.items())
    parsed = (
        lines.withColumn("line", strip(F.col("line")))
        .withColumn("_h", header_fields(F.col("line")))
        .withColumn("_m", message_groups(F.expr("try_element_at(_h, 5)")))
        .selectExpr(
            *[c for c in lines.columns if c != "line"],
            "line",
            f"inline(if(size(_h) = 5, array(struct({row})), array()))",
        )
    )
    rejects = parse_header(lines).filter("reject_reason IS NOT NULL")
    return parsed, rejects.selectExpr("event_seq", "line AS raw", "reject_reason", "ingested_at")


def normalize_parsed(parsed: DataFrame, year: int | None = None) -> DataFrame:
    """Parsed lines to the event schema.

    Header times carry no year: ``year`` supplies it, else the year of ``ingested_at``. A time that is no date falls
    back to ``ingested_at`` and is marked by ``ts_inferred``.
    """
    in_year = F.lit(year) if year is not None else F.year(utc_wall(F.col("ingested_at")))
    ts = syslog_ts(F.col("clock"), in_year)
    return (
        parsed.withColumn("_ts", ts)
        .withColumns(
            {
                "event_ts": F.coalesce("_ts", "ingested_at"),
                "event_wall": utc_wall(F.coalesce("_ts", "ingested_at")),
                "ts_inferred": F.col("_ts").isNull(),
                "severity": action_severity("action"),
                "raw": F.col("line"),
                "metadata": F.lit(None).cast(EVENT_COLUMNS["metadata"]),
            }
        )
        .select(*EVENT_COLUMNS)
    )


# Fields of a submitted JSON event.
_JSON_FIELDS = {
    name: "string"
    for name in (
        "timestamp", "source_ip", "hostname", "service", "action", "user", "destination_port", "severity", "raw", "message"
    )
} | {"metadata": "map<string,string>"}


def parse_json_events(docs: DataFrame, reroute_raw: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(json_rows, raw_lines, rejects)`` of JSON texts ``event_seq, value, ingested_at``.

    A document ``{"raw": line}`` is a raw line and goes to the line parser. Text that is no JSON object is
    ``bad_json``; an action that is not text, or metadata that is not an object, is ``bad_field``. The text is parsed
    once, into a variant, where an explicit null differs from an absent field.
    """
    typed = docs.select("event_seq", "ingested_at", "value", F.try_parse_json("value").alias("_v")).selectExpr(
        "*",
        "schema_of_variant(_v) AS _type",
        *[
            f"schema_of_variant(try_variant_get(_v, '$.{name}', 'variant')) AS _{name}"
            for name in ("action", "metadata", "raw")
        ],
    )
    judged = typed.selectExpr(
        "*", f"coalesce(_raw = 'STRING', false) AND {str(reroute_raw).lower()} AS _is_raw"
    ).selectExpr(
        "*",
        """CASE WHEN _type IS NULL OR NOT startswith(_type, 'OBJECT') THEN 'bad_json'
            WHEN _is_raw THEN null
            WHEN _action != 'STRING' OR NOT startswith(_metadata, 'OBJECT') THEN 'bad_field' END AS reject_reason""",
    )
    rejects = judged.filter("reject_reason IS NOT NULL")
    # generators, not filters, for the reason given in parse_syslog
    fields = ", ".join(f"try_variant_get(_v, '$.{name}', '{kind}') AS {name}" for name, kind in _JSON_FIELDS.items())
    rows = judged.selectExpr(
        "event_seq",
        "ingested_at",
        "value",
        f"inline(if(reject_reason IS NULL AND NOT _is_raw, array(struct({fields})), array()))",
    )
    raw = judged.selectExpr(
        "event_seq", "explode(if(_is_raw, array(try_variant_get(_v, '$.raw', 'string')), array())) AS line", "ingested_at"
    )
    return rows, raw, rejects.selectExpr("event_seq", "value AS raw", "reject_reason", "ingested_at")


def normalize_json(rows: DataFrame) -> DataFrame:
    """JSON rows to the event schema: upper-case action (``OTHER`` if absent); a known action decides the severity,
    else the supplied one, else ``info``."""
    return (
        rows.withColumns(
            {
                "action": F.upper(F.coalesce("action", F.lit("OTHER"))),
                "_ts": iso_ts(F.col("timestamp")),
            }
        )
        .withColumns(
            {
                "event_ts": F.coalesce("_ts", "ingested_at"),
                "event_wall": F.coalesce(iso_wall(F.col("timestamp")), utc_wall(F.col("ingested_at"))),
                "ts_inferred": F.col("_ts").isNull(),
                "source_ip": _blank_to_null(F.col("source_ip")),
                "user": _blank_to_null(F.col("user")),
                "destination_port": F.col("destination_port").try_cast("bigint"),
                "severity": action_severity("action", "severity"),
                "raw": F.col("value"),
                "pid": F.lit(None).cast("string"),
            }
        )
        .select(*EVENT_COLUMNS)
    )


def _parsed_envelopes(envelopes: DataFrame) -> DataFrame:
    """Envelopes ``value`` with ``reject_reason``, or else their arrays ``_e.logs`` and ``_e.events``; other columns stay."""
    typed = envelopes.selectExpr("*", "try_parse_json(value) AS _v").selectExpr(
        "*",
        "schema_of_variant(_v) AS _type",
        *[f"schema_of_variant(try_variant_get(_v, '$.{name}', 'variant')) AS _{name}" for name in ("logs", "events")],
    )
    return typed.selectExpr(
        *envelopes.columns,
        """CASE WHEN _type IS NULL OR NOT startswith(_type, 'OBJECT') THEN 'bad_json'
            WHEN NOT startswith(_logs, 'ARRAY') OR NOT startswith(_events, 'ARRAY') THEN 'bad_field' END AS reject_reason""",
    ).selectExpr("*", "if(reject_reason IS NULL, from_json(value, 'logs array<string>, events array<string>'), null) AS _e")


def bulk_entries(envelopes: DataFrame) -> DataFrame:
    """The entries of bulk envelopes ``value`` in order, lines before documents: ``kind`` (``line``, ``entry``, ``reject``), ``value``
    and ``reject_reason`` beside the other columns. A broken envelope is one ``reject``."""
    passed = [c for c in envelopes.columns if c != "value"]
    row = "struct('{kind}' AS kind, {value} AS value, {reason} AS reject_reason)"
    none = "CAST(null AS string)"
    one = row.format(kind="reject", value="value", reason="reject_reason")
    parts = [
        f"transform(coalesce(_e.{name}, array()), x -> {row.format(kind=kind, value='x', reason=none)})"
        for name, kind in (("logs", "line"), ("events", "entry"))
    ]
    return _parsed_envelopes(envelopes).selectExpr(
        *passed, f"inline(if(reject_reason IS NULL, concat({', '.join(parts)}), array({one})))"
    )


#: Room for the entries of one batch in ``event_seq``, in bits; the rest is the batch's number.
_ENTRY_BITS = 24


def explode_bulk(envelopes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lines, docs, rejects)`` of bulk envelopes ``batch_seq, value, ingested_at`` of the form ``{logs: [..], events: [..]}``.

    Text that is no JSON object (or repeats a key) is ``bad_json``; ``logs`` or ``events`` that are no array are
    ``bad_field``; such an envelope gives its own row as reject and nothing else.

    ``event_seq`` keeps the order of submission: a batch's lines come before its events. It leaves room for 2**24 entries
    in a batch and 2**39 batches; what doesn't fit is an error, as its numbers would repeat.
    """
    parsed = _parsed_envelopes(envelopes).selectExpr("*", "coalesce(array_size(_e.logs), 0) AS _n")
    entries = "_n + coalesce(array_size(_e.events), 0)"
    kept = parsed.selectExpr(
        "*",
        f"""CASE WHEN batch_seq NOT BETWEEN 0 AND {2 ** (63 - _ENTRY_BITS) - 1} OR {entries} > {2**_ENTRY_BITS}
            THEN raise_error('no room for the numbers of batch ' || batch_seq)
            ELSE shiftleft(batch_seq, {_ENTRY_BITS}) END AS _base""",
    )
    lines = kept.select("_base", "ingested_at", F.posexplode("_e.logs").alias("_p", "line")).select(
        (F.col("_base") + F.col("_p")).alias("event_seq"), "line", "ingested_at"
    )
    docs = kept.select("_base", "_n", "ingested_at", F.posexplode("_e.events").alias("_p", "value")).select(
        (F.col("_base") + F.col("_n") + F.col("_p")).alias("event_seq"), "value", "ingested_at"
    )
    rejects = kept.where("reject_reason IS NOT NULL").selectExpr(
        "_base AS event_seq", "value AS raw", "reject_reason", "ingested_at"
    )
    return lines, docs, rejects
