"""Conversation repair and the prefix trie against plain Python versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from sparkwarden.llm import common, prefix_trie, turn_repair
from sparkwarden.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int, out string"


def cheapest(rows):
    """The least ``(cost, audit)`` of ``(initial, fault)`` rows by recursion over all derivations."""

    @lru_cache(None)
    def go(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in (0, 3) else []
        write = "a" if state == 2 else "u"
        after = {"s": 1, "u": 2, "a": 3}
        options = []
        if inserted < 2:
            options.append((5, "I", go(i, after[write], inserted + 1)))
        if i < len(rows):
            initial, fault = rows[i]
            options.append((2, "D", go(i + 1, state, 0)))
            if fault in (0, 3):
                options.append((1 + 5 * (fault == 3), "R", go(i + 1, after[write], 0)))
                if initial == write or (state, initial) == (0, "s"):
                    options.append((5 * (fault == 3), "K", go(i + 1, after[initial], 0)))
        return min(out + [(c + cost, e + audit) for c, e, (cost, audit) in options], default=(10**9, ""))

    return go(0, 0, 0)


def repaired(rows):
    """All columns of the repair of ``(turn, role, text)`` rows."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=str_key)
    seen, found, said = set(), [], []
    for _, _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = 1
        elif (role, text) in seen:
            fault = 2
        else:
            fault = 0 if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else 3
        seen.add((role, text))
        found.append((role[:1], fault))
    cost, audit = cheapest(tuple(found))
    state, at = "", 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][2:]
        at += edit != "I"
        if edit != "D":
            state = role[:1] if edit == "K" else "a" if state == "u" else "u"
            said.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    turns = sorted({t for there, t, _, _ in rows if there})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
    faults = [f for _, f in found]
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def str_key(row):
    there, turn, role, text = row
    return there, turn, role, text[:64], hashlib.sha256(text.encode()).hexdigest()


def random_rows(seed, convs=60, longest=14):
    rng = random.Random(seed)
    texts = ["Hi.", "a b!", "no end", " \t", "", None, "x\n.\n", "ok?", "é漢🙂.", "long " * 40 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for c in [None, *range(-convs // 2, convs // 2)]:
        for _ in range(rng.randrange(longest)):
            rows.append((c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("segment", [128, 3, 1])
def test_agenda_equals_all_derivations(monkeypatch, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(13))]
        now = turn_repair.Deduction()
        for initial, fault in rows:
            now.read(None, initial, fault)
        assert now.result()[5:] == cheapest(tuple(rows))


def test_a_long_conversation_is_deduced_in_segments():
    now = turn_repair.Deduction()
    for k in range(50_000):
        now.read(k, "ua"[k % 2], 0)
    assert now.result() == (0, 0, 0, 0, 0, 0, "K" * 50_000)


def test_repairs_equal_the_plain_version(spark):
    rows = random_rows(7)
    df = spark.createDataFrame([(*r, "extra", 1, "x") for r in rows], SCHEMA)
    found = turn_repair.repairs(df)
    digests = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(turn_repair.repaired(df, found)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*list(r)[1:], digests.get(r.conv_id, empty)) for r in found.collect()}
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = repaired([r[1:] for r in rows if r[0] == c])
    assert got == want


def test_left_out_rows_leave_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", True), (1, 1, "user", "a.", False), (2, 0, None, None, True)], "conv_id long, turn long, role string, text string, gone boolean")
    got = {r.conv_id: (r.duplicate, r.cost, r.audit) for r in turn_repair.repairs(df, left_out="gone").collect()}
    assert got == {1: (0, 2, "D"), 2: (0, 0, "")}
    none = df.limit(0)
    found = turn_repair.repairs(none)
    assert found.count() == 0 and turn_repair.digests(turn_repair.repaired(none, found)).count() == 0


def paths(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    return {c: [r[2:] for r in sorted(v, key=lambda r: (*r[:3], r[3][:64], digest(*r[2:])))] for c, v in by.items()}


def spliced(by):
    out = {}
    for c, own in by.items():
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = by.get(first, [])[:h] + own[h:]
    return out


def plain_trie(by):
    """The contract's columns by one pass over all beginnings."""
    members = {}
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, weight, leaves = {}, {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        weight[node] = (len(members[node]) - 1) * size + sum(weight[n] for n in children.get(node, []))
        leaves[node] = sum(leaves[n] for n in children.get(node, [])) or 1
        ends = ",".join(str(c) for c in sorted(members[node]) if len(by[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children.get(node, [])), leaves[node], weight[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(seed, convs=150):
    """Many common beginnings, whole copies, one long conversation, and odd values."""
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no id")]
    for c in range(-20, convs):
        kind = rng.random()
        if kind < 0.1:
            continue
        texts = ["same"] * 6 if kind < 0.4 else [rng.choice(["a", "b", "", "é" * 70]) for _ in range(rng.randrange(1, 12))]
        rows += [(c, rng.choice([None, k]) if kind > 0.9 else k, rng.choice(["user", None]) if k > 4 else "user", rng.choice([t, None]) if k > 5 else t) for k, t in enumerate(texts)]
    rows += [(convs + 5, k, "user", f"turn {k}") for k in range(200)] + [(convs + 5, 7, "user", "turn 7")]
    return rows


@pytest.mark.parametrize("block, share, part", [(4, 256, 1 << 16), (1, 4, 40), (3, 2, 5)])
def test_trie_equals_the_plain_version(spark, monkeypatch, block, share, part):
    monkeypatch.setattr(common, "HEAVY_SHARE", share)
    monkeypatch.setattr(prefix_trie, "PART_CHARS", part)
    rows = trie_rows(block)
    df = spark.createDataFrame([(*r, "extra", 1, "x") for r in rows], SCHEMA)
    for order, want in ((prefix_trie.in_order, paths(rows)), (prefix_trie.spliced, spliced(paths(rows)))):
        got = sorted((tuple(r) for r in prefix_trie.trie(order(df), block).collect()), key=repr)
        assert got == plain_trie(want)


def test_no_conversation(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.in_order(none)).count() == 0
    assert prefix_trie.trie(prefix_trie.spliced(none)).count() == 0


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_prefix_trie"])
def test_queries_equal_sql_on_odd_rows(spark, tmp_path, name):
    rows = [r for seed in range(3) for r in random_rows(seed, 30 + seed)] + trie_rows(9, 60)
    rows = [r for r in rows if r[0] is not None] if name == "op12_prefix_trie" else rows
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
