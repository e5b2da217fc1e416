"""Chat formatting, SentencePiece encoding and packing against their libraries and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkwarden.llm import bpe_pieces, chat, packing, queries

WORD_FILE = queries.tokenizer_file("byte_bpe_50k.json")
PIECE_FILE = queries.tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "a", "a b  c", "\n\n x\n", "é漢🙂 ▁ ▁▁", "</s>[INST] <|end|> <\\|turn|> [\\INST]", "<|endoftext|> it's 'll\tx\0y", "word " * 3000]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(3)
    bits = ["<", "|", "\\", "s>", "/", "[", "INST]", "</s>", "<|end|>", "<|turn|>", " ", "x"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", t) for t in ODD[:3]] + [(1, 0, "user", "hi")]
    rows += [(2, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(ODD)]
    rows += [(3, 0, None, None), (3, 1, "assistant", None), (None, 0, "assistant", "no id"), (4, None, "assistant", "z"), (4, None, "assistant", "z")]
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], "conv_id long, turn long, role string, text string, ids string, loss int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, WORD_FILE)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role is not None, role or "", x or "") for c, t, role, x in rows if c == conv))
        whole = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        learned = "".join(t[4] for t in turns if t[3] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(learned)
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(r.formatted)


def test_no_conversation(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df, WORD_FILE)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return bpe_pieces.PieceEncoder(PIECE_FILE)


def test_pieces_equal_the_library(pieces):
    rng = random.Random(5)
    letters = list(" ▁aabcdehilnorstéüñ漢\n\tTHE0129.,")
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(rng.choice(list(pieces.ids)) for _ in range(rng.randrange(12))) for _ in range(3000)]
    want = pieces.library.encode(texts, add_bos=True, add_eos=True)
    made = list(pieces.encode(pa.array(texts)))
    assert [ids(x) for x in made] == want
    assert [pieces.decode(x) for x in made] == [pieces.library.decode(w) for w in want]


def test_pieces_of_a_table(spark, pieces):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe_pieces.with_pieces(df, PIECE_FILE, decoded="decoded").collect()}
    for i, t, _ in rows:
        want = pieces.library.encode(t or "", add_bos=True, add_eos=True)
        assert ids(got[i].ids) == want and got[i].decoded == pieces.library.decode(want)
    assert bpe_pieces.with_pieces(df.limit(0), PIECE_FILE).count() == 0


def test_words_equal_the_library():
    encoder = packing.Encoder(WORD_FILE)
    rng = random.Random(8)
    parts = ["a", "the", "Word", "é", "漢", "12", "'s", "don't", ".", "!!", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "<|", "x"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in encoder.encode(pa.array(texts))] == want


def test_files_whose_ids_are_no_ranks_go_through_their_library(tmp_path):
    assert len(packing.merge_ranks(WORD_FILE)) == 50_256
    other = packing.Encoder(queries.tokenizer_file("word_bpe_49k.json"))
    assert other.by_rank is None
    want = other.tokenizer.encode("Some words, here", add_special_tokens=False).ids
    assert [ids(x) for x in other.encode(pa.array(["Some words, here"]))] == [want]


def check_packing(rows, docs, windows):
    """Every id in one piece, sequences gapless and of a power of two."""
    encoder = packing.Encoder(WORD_FILE)
    want = {}
    for k, (doc, text) in enumerate(docs):
        want.setdefault((doc, text or ""), []).append(k)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        whole = ids(next(iter(encoder.encode(pa.array([text or ""]))))) + [1]
        mine = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert sum((ids(r.ids) for r in mine), []) == whole
        assert {r.doc_tokens for r in mine} == {len(whole)}
    total = 0
    for pieces_ in by_sequence.values():
        pieces_.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces_] == np.cumsum([0] + [r.length for r in pieces_])[:-1].tolist()
        size = sum(r.length for r in pieces_)
        assert size <= windows[-1] and size & (size - 1) == 0 and {r.window_tokens for r in pieces_} == {size}
        total += size
    return total


@pytest.mark.parametrize("buffer", [1 << 21, 3000])
def test_packing(spark, sf_dir, monkeypatch, buffer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, start int, length int").coalesce(2)
    monkeypatch.setattr(packing, "BUFFER_TOKENS", buffer)
    rows = packing.pack(df, WORD_FILE).collect()
    check_packing(rows, docs, packing.WINDOWS)
    per_step = {}
    for r in rows:
        per_step[r.step_group] = per_step.get(r.step_group, 0) + r.length
    assert max(per_step.values()) == 32_768 or len(per_step) < 5
    assert len(rows) < 3 * len(docs)


def test_packing_few(spark):
    df = spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, WORD_FILE).collect()
    assert sum(r.length for r in rows) == 5 and {r.doc_tokens for r in rows} == {1, 2}
    assert packing.pack(df.limit(0), WORD_FILE).count() == 0


def test_tiers_fill_every_window():
    rng = random.Random(2)
    tiers = packing._Tiers((4, 8, 16))
    sizes = [rng.randrange(1, 17) for _ in range(200)]
    for k, s in enumerate(sizes):
        tiers.add(s, k, 0)
    made = list(tiers.pack(last=False))
    assert all(sum(p[0] for p in pieces_) == w for w, pieces_ in made)
    made += list(tiers.pack(last=True))
    assert sum(w for w, _ in made) == sum(sizes)
    covered = sorted((doc, start, size) for _, pieces_ in made for size, doc, start in pieces_)
    for k, s in enumerate(sizes):
        mine = [c for c in covered if c[0] == k]
        assert sum(c[2] for c in mine) == s and [c[1] for c in mine] == np.cumsum([0] + [c[2] for c in mine])[:-1].tolist()


def test_crc_is_that_of_the_ids(spark, sf_dir):
    got = {(r.doc_id, r.start): r.ids_crc32 for r in queries.QUERIES["op8_packing"](spark, sf_dir).collect()}
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in packing.pack(df, WORD_FILE).collect()}
    assert got == want
