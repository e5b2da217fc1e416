"""Near-duplicate operators against brute force."""

import itertools
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwarden.llm import line_dedup, metric_join, queries, simhash
from sparkwarden.llm.components import components


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("chunk", [0, 10**6])
def test_components(spark, chunk):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(df, chunk).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == reach(ends, [x for x in links if x[0] != x[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for text in ["", "  \n", "A", "a B\tc", "Één ÉÉN x y z z z z", "w " * 50_000, "a b c d\x0ce"]:
        assert simhash.fingerprint(text, 3) & (2**64 - 1) == plain_fingerprint(text)
    assert simhash.fingerprint(None, 3) == 0


def test_simhash_links(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for p in base:
        for _ in range(12):
            q = p
            for b in rng.sample(range(64), rng.randrange(5)):
                q ^= 1 << b
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for bits in (0, 1, 2, 3):
        want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert {(r.a, r.b) for r in simhash.links(df, bits).collect()} == want
    with pytest.raises(ValueError):
        simhash.links(df, 8)


@pytest.mark.parametrize("bits", range(8))
def test_some_list_holds_each_pair_within_the_distance(bits):
    lists = [set(c) for c in simhash.choices(bits)]
    for differing in itertools.combinations(range(8), bits):
        assert any(not c & set(differing) for c in lists)
    assert bits != 2 or (len(lists) < 16 and all(len(c) == 5 for c in lists))


def test_the_tally_removes_pairs_below_the_minimum(spark):
    three_bytes, two_bytes, two_bits = 0x010101, 0x0303, 0x0101
    df = spark.createDataFrame([(0,), (three_bytes,), (two_bytes,), (two_bits,)], "fp long")
    met = {(r.a, r.b) for r in simhash.candidates(df, 2).collect()}
    assert {(0, two_bytes), (0, two_bits)} <= met
    assert {(r.a, r.b) for r in simhash.links(df, 2).collect()} == {(0, two_bits), (two_bits, two_bytes), (two_bits, three_bytes)}
    # pairs of three differing bytes meet in lists as well, and share fewer bytes than the minimum
    apart = [(1 << 8 * i) | (1 << 8 * j) | (1 << 8 * k) for i, j, k in itertools.combinations(range(7), 3)]
    met = simhash.candidates(spark.createDataFrame([(p,) for p in [0, *apart]], "fp long"), 2)
    assert met.where("a = 0").count() > 0
    assert met.where((F.col("a") == 0) & (simhash._tally(F.col("a"), F.col("b")) >= 6)).count() == 0


def test_simhash_groups(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, " "), (None, "x y z"), (9004, "x y z"), (9004, "x y z"), (9005, docs[0][1] + " end")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, fp int, component_id int")
    rows = simhash.near_duplicates(df).collect()
    prints = [(d, plain_fingerprint(t or "")) for d, t in docs]
    values = sorted({p for _, p in prints})
    root = reach(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = sorted(((d, p, least[root[p]]) for d, p in prints), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows), key=str) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, c in want if d is None or d == c), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_removed(docs, shingle, similarity):
    places = {}
    for doc, text in sorted(set(docs), key=lambda d: d[0]):
        for n, line in enumerate((text or "").split("\n")):
            if folded := line_dedup.fold(line):
                places.setdefault(folded, []).append((doc, n))
    sets = {f: line_dedup.shingles(f, shingle) for f in places}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if line_dedup.jaccard(sets[a], sets[b]) >= similarity]
    group = {}
    for f, root in reach(list(sets), links).items():
        group.setdefault(root, []).extend(places[f])
    return {x for v in group.values() for x in sorted(v)[1:]}


def family(rng, size):
    """Variants of one line, all close to it and to each other."""
    words = [rng.choice("alpha beta gamma delta epsilon zeta theta iota kappa lambda".split()) + str(rng.randrange(90)) for _ in range(40)]
    out = []
    for k in range(size):
        line = list(words)
        line[k % 40] = f"v{k}"
        out.append(" ".join(line))
    return out


@pytest.mark.parametrize("few, block", [(32, 256), (4, 8)])
def test_line_dedup(spark, monkeypatch, few, block):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(6)
    lines = family(rng, 45) + family(rng, 3) + ["x", "X ", "short", "", "  ", "same line", "SAME  line"]
    lines += [" ".join(str(rng.randrange(1000)) for _ in range(30)) for _ in range(30)]
    rng.shuffle(lines)
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[5][1]), (103, docs[5][1])]
    rows = [(*d, "keep", -1, 5) for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, removed int, n_chars long").repartition(4)
    got = line_dedup.dedup_lines(df).collect()
    removed = {(r.doc_id, n) for r in got for n in r.removed}
    assert removed == brute_removed(docs, line_dedup.SHINGLE, line_dedup.SIMILARITY)
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        assert r.row == "keep"
        if texts[r.doc_id] is None:
            assert r.text is None and r.n_removed == 0 and r.n_chars is None
            continue
        parts = texts[r.doc_id].split("\n")
        assert r.n_lines == len(parts)
        assert r.text == "\n".join(x for n, x in enumerate(parts) if (r.doc_id, n) not in removed)
        assert r.n_chars == len(r.text)


def test_shingle_sets_equal_python_sets(monkeypatch):
    monkeypatch.setattr(line_dedup, "CHECK_SHINGLES", 500)
    rng = random.Random(9)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 60))) for _ in range(120)] + ["é漢🙂" * 20, "x", "abcdef", "y" * 3000]
    lines += [x[:-1] + "z" for x in lines[:60]]
    sets = [line_dedup.shingles(x, 6) for x in lines]
    a, b = (np.array(x) for x in zip(*itertools.combinations(range(len(lines)), 2), strict=True))
    got = line_dedup.ShingleSets(lines, 6).alike(a, b, 0.8)
    assert got.tolist() == [line_dedup.jaccard(sets[i], sets[j]) >= 0.8 for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.sum() > 20


def test_a_large_family_gives_no_blocks(spark):
    """The rows that go on grow with the lines of a near-copy group, not with their square; very long lines do, too."""
    rng = random.Random(13)
    copies = family(rng, 4000)
    long_lines = [(" ".join(str(rng.randrange(10**6)) for _ in range(17_000)))[:118_000] for _ in range(2)]
    long_lines += [x + f" end{k}" for k, x in enumerate(long_lines)]
    docs = [(k, x) for k, x in enumerate([*copies, *long_lines])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = df.mapInArrow(line_dedup._lines(6, 12, 5), "doc_id long, row long, line int, h long, bands array<long>").persist()
    links = line_dedup.line_links(df, lines, 6, 0.8).distinct().collect()
    assert len(links) < 12 * len(docs)
    assert len(set(reach([line_dedup.line_hash(x) for _, x in docs], [(r.a, r.b) for r in links]).values())) == 3
    lines.unpersist()


def test_blocks_of_shingle_sets_equal_python_sets(monkeypatch):
    monkeypatch.setattr(line_dedup, "COLUMNS", 7)
    rng = random.Random(10)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["é漢🙂" * 20, "x", "y" * 3000]
    lines += [x[:-1] + "z" for x in lines[:30]] + lines[:2]
    sets = [line_dedup.shingles(x, 6) for x in lines]
    held = line_dedup.ShingleSets(lines, 6)
    for at in (slice(0, 50), slice(50, len(lines))):
        got = held.alike_blocks(slice(50, len(lines)), at, 0.8)
        np.fill_diagonal(got, got.diagonal() | (at.start == 50))  # a line with itself is not told
        assert got.tolist() == [[line_dedup.jaccard(a, b) >= 0.8 for b in sets[at]] for a in sets[50:]]
    assert got.sum() > 45
    assert not line_dedup.ShingleSets(["one", "two"], 6).alike_blocks(slice(0, 1), slice(1, 2), 0.8).any()


def test_band_keys_travel_in_arrays_and_meet_one_line_of_their_key(spark, monkeypatch):
    """Far fewer rows than band keys are shuffled, and a task that gives out its lines bit by bit keeps the first of each key."""
    monkeypatch.setattr(line_dedup, "DEAL_KEYS", 500)
    rng = random.Random(14)
    rows = [(h, [k * 10**15 for k in rng.sample(range(-40, 400), 3)] + [77]) for h in range(2000)] + [(5, [77]), (9000, [])]
    df = spark.createDataFrame(rows, "h long, bands array<long>").repartition(4)
    dealt = df.mapInArrow(line_dedup._dealt(10), "bucket int, keys array<long>, hs array<long>").collect()
    assert len(dealt) < 300
    expected, found = {}, {}
    for h, keys in rows:
        for key in keys:
            expected.setdefault(key, set()).add(h)
    posted = [(key, h) for r in dealt for key, h in zip(r.keys, r.hs, strict=True)]
    assert sorted(posted) == sorted((key, h) for h, keys in rows for key in keys)
    assert len({(key, r.bucket) for r in dealt for key in r.keys}) == len(expected)
    parts = spark.createDataFrame(dealt, "bucket int, keys array<long>, hs array<long>").repartition(2, "bucket")
    for r in parts.mapInArrow(line_dedup._with_first(300), "key long, a long, b long").collect():
        assert r.a != r.b
        found.setdefault(r.key, set()).add((r.a, r.b))
    assert all(len({a for a, _ in pairs}) == 1 for pairs in found.values())
    assert {key: {x for pair in pairs for x in pair} for key, pairs in found.items()} == {k: h for k, h in expected.items() if len(h) > 1}


def test_fold_of_white_space_and_case():
    rng = random.Random(15)
    for _ in range(3000):
        line = "".join(rng.choice(["a", "B", "Σ", "İ", " ", "  ", "\t", "\xa0", "\u3000", "\x1c", "\x85", "\u200b", "é", "1"]) for _ in range(rng.randrange(6)))
        assert line_dedup.fold(line) == " ".join(line.lower().split())


def test_line_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, removed int")
    assert line_dedup.dedup_lines(df).count() == 0
    plain = line_dedup.dedup_lines(df, report=False)
    assert plain.columns == df.columns and plain.count() == 0


def test_null_ids_keep_their_lines_once(spark):
    df = spark.createDataFrame([(None, "one line here\nother"), (None, "one line here"), (1, "one line here")], "doc_id long, text string")
    got = line_dedup.dedup_lines(df).collect()
    assert sum("one line here" in r.text for r in got) == 1


def test_bands_recall_their_pairs():
    rng = random.Random(12)
    base = [" ".join(str(rng.randrange(10_000)) for _ in range(40)) for _ in range(300)]
    other = [x.replace(x.split()[7], "new").replace(x.split()[20], "word") for x in base]
    pairs = [(a, b) for a, b in zip(base, other, strict=True) if line_dedup.jaccard(line_dedup.shingles(a, 6), line_dedup.shingles(b, 6)) >= 0.8]
    keys = [line_dedup.band_keys([p[i] for p in pairs], 6, line_dedup.BANDS, line_dedup.ROWS) for i in (0, 1)]
    assert len(pairs) > 200 and (keys[0] == keys[1]).any(axis=1).mean() >= 0.97


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL_ROWS", 40)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 8))
    x = np.concatenate([x, x[:60] + 0.1 * rng.standard_normal((60, 8)), x[:1] + 0.02 * rng.standard_normal((70, 8)), x[:5], 3 * x[:5]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0, None] + [1.0] * 6), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows + odd + rows[:2]], "vec_id long, embedding array<float>, key string, n_links int").repartition(3)
    got = metric_join.near_duplicates(df, 0.95).collect()
    assert len(got) == len(rows) + len(odd) + 2
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = reach(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    for r in got:
        if r.vec_id < 900:
            assert (r.n_links, r.component_id, r.kept) == (linked[r.vec_id].sum(), root[r.vec_id], root[r.vec_id] == r.vec_id)
        elif r.vec_id < 905:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id) == (1, 905)
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def linked_by_brute_force(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = reach(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    return linked.sum(axis=1), [root[k] for k in range(len(x))]


def test_metric_join_stores_vectors_once(spark, monkeypatch):
    """In many dimensions nearly every vector is a boundary copy of most cells; no copy is written, nor a vector for each block it meets."""
    monkeypatch.setattr(metric_join, "CELL_ROWS", 100)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 50)
    written, stored = [], metric_join.cut

    def recorded(df):
        out = stored(df)
        sizes = [F.octet_length(c) for c, kind in out.dtypes if kind == "binary"] + [F.size(c) * 4 for c, kind in out.dtypes if kind == "array<float>"]
        written.extend(out.select(F.sum(size)).first()[0] or 0 for size in sizes)
        return out

    monkeypatch.setattr(metric_join, "cut", recorded)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2000, 64))
    x = np.concatenate([x, x[:100] + 0.02 * rng.standard_normal((100, 64)), x[:1] + 0.02 * rng.standard_normal((100, 64))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in metric_join.near_duplicates(df, 0.95).collect()}
    n, root = linked_by_brute_force(x)
    assert [(got[k].n_links, got[k].component_id) for k in range(len(x))] == [(n[k], root[k]) for k in range(len(x))]
    assert sum(written) < 2 * x.nbytes


@pytest.mark.parametrize(("dim", "kind"), [(5, "double"), (40, "float")])
def test_metric_join_by_slabs(spark, monkeypatch, dim, kind):
    """Many slabs, cells that fill several slabs, small tiles: each pair meets once."""
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 8), ("SLAB_BYTES", 30 * dim * 8), ("TILE_PAIRS", 64), ("HELD_BYTES", 4000)):
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((200, dim))
    x = np.concatenate([x, x[:40] * 3 + 0.05 * rng.standard_normal((40, dim)), x[:1] + 0.05 * rng.standard_normal((80, dim))]).astype(np.float32)
    short = x[:30, :3].copy()
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v.tolist()) for k, v in enumerate(short)]
    df = spark.createDataFrame(rows + rows[:3], f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {r.vec_id: r for r in metric_join.near_duplicates(df, 0.95).collect()}
    for part, at in ((x, 0), (short, 1000)):
        n, root = linked_by_brute_force(part)
        assert [(got[at + k].n_links, got[at + k].component_id) for k in range(len(part))] == [(n[k], at + root[k]) for k in range(len(part))]


def test_short_products_bound_cosines():
    rng = np.random.default_rng(4)
    x = metric_join.unit(rng.standard_normal((300, 32)) * np.linspace(3, 0.1, 32))
    basis = metric_join.leading(x, 0.95)
    assert basis.shape[1] < 32 and np.allclose(basis.T @ basis, np.eye(basis.shape[1]))
    z = metric_join.shortened(x, basis)
    assert (z @ z.T >= x @ x.T - 1e-6).all()
    for share in (0.0, 1e-4, 0.5):
        hit = rng.random((37, 211)) < share
        assert all((a == b).all() for a, b in zip(metric_join.true_cells(hit), np.nonzero(hit), strict=True))


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    for density in (0.02, 0.5):
        linked = rng.random((40, 60)) < density
        r, c = metric_join.forest(np.tile(linked, (3, 3)) if density > 0.1 else linked)
        whole = np.tile(linked, (3, 3)) if density > 0.1 else linked
        nodes = range(sum(whole.shape))
        side = whole.shape[0]
        every = [(int(a), side + int(b)) for a, b in zip(*np.nonzero(whole), strict=True)]
        some = [(int(a), side + int(b)) for a, b in zip(r, c, strict=True)]
        assert reach(nodes, every) == reach(nodes, some) and set(some) <= set(every)


def test_queries_carry_every_row(spark, sf_dir):
    assert queries.QUERIES["op3_simhash"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.QUERIES["op9_metric_join"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_lines_of_a_text_fold_like_single_lines():
    rng = random.Random(16)
    signs = ["a", "B", "Σ", "İ", "ß", " ", " ", "\n", "\n", "\t", "\r", "\xa0", "　", "\x1c", "\x85", "​", " ", "é", "\ud800"]
    for k in range(4000):
        text = "".join(rng.choice(signs[: 9 if k % 2 else None]) for _ in range(rng.randrange(12)))
        assert line_dedup.folded_lines(text) == [line_dedup.fold(x) for x in text.split("\n")]
    assert set(line_dedup.ODD_SPACE) | set(" \n") == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_longs_travel_as_bytes():
    """Arrays of longs and their bytes say the same, with nulls, empty rows and parts of a batch; both forms of lines give the same links."""
    rows = [[1, -(2**63)], None, [], [2**63 - 1], None, [5, 6, 7]]
    plain = pa.record_batch({"n": pa.array(range(6)), "x": pa.array(rows, pa.list_(pa.int64()))})
    for batch in (plain, plain.slice(1, 4), plain.slice(1, 2), plain.slice(0, 0)):
        (packed,) = line_dedup._as_bytes(lambda b: b, "x")(iter([batch]))
        assert pa.types.is_binary(packed.column("x").type) and packed.column("n").equals(batch.column("n"))
        assert packed.column("x").null_count == batch.column("x").null_count
        for part in (packed, packed.slice(1)):
            want = rows if batch is plain else batch.column("x").to_pylist()
            want = want[1:] if part is not packed else want
            values, sizes = line_dedup._longs(part.column("x"))
            assert values.tolist() == [v for r in want for v in r or []] and sizes.tolist() == [len(r or []) for r in want]


def test_lines_and_band_keys_are_stored_as_bytes(spark, monkeypatch):
    """What is written for all lines and dealt to buckets has no array that Spark copies value by value, and texts are not sorted."""
    stored, store = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: stored.append(df) or store(df))
    df = spark.createDataFrame([(k, f"the very same line of text\nline number {k}, of its own") for k in range(40)], "doc_id long, text string")
    out = line_dedup.dedup_lines(df)
    assert sum(r.n_removed for r in out.collect()) >= 39
    kinds = {(f.name, f.dataType.simpleString()) for d in stored for f in d.schema.fields}
    assert ("bands", "binary") in kinds and not any(kind == "array<bigint>" for _, kind in kinds)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
