"""Packing, token counts and token files against the tokenizer libraries on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import packing, token_binary, token_counts
from postlens.llm.pieces import json_tokenizer, piece_tokenizer, tokenizer_path
from tests.llm.conftest import ODD_TEXTS, texts_of


def noise(n=400):
    rng = random.Random(5)
    parts = ["a", "B", "é", "ß", "İ", "KEDİ,", "Σ.", "1", "22", ".", ",", "'", "'s", "'ll", "!", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "▁", "_", "word", "Word,", "it's", "<s>", "<|endoftext|>", "<|EndOfText|>", "漢字", "🙂", "́", "ﬁ", "Σ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    coder = json_tokenizer(tokenizer_path(name))
    texts = [t or "" for t in ODD_TEXTS] + noise() + ["KEDİ, köpek", "TÜRKİYE, DENİZİ. SON"] + [f"a{chr(c)}. b{chr(c)}, c" for c in range(0x30, 0x250)]
    counts, ids = coder.encode(pa.array(texts, pa.large_string()))
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == coder.library.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_pieces_give_the_librarys_counts():
    counter = piece_tokenizer(tokenizer_path("piece_bpe_32k.model"))
    texts = [t or "" for t in ODD_TEXTS] + noise()
    got = counter.count(pa.array(texts, pa.large_string())).tolist()
    for text, n in zip(texts, got, strict=True):
        assert n == len(counter.library.encode(text)), repr(text)


def test_cache_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr("postlens.llm.pieces.MOST_PIECES", 8)
    coder = json_tokenizer.__wrapped__(tokenizer_path("byte_bpe_50k.json"))
    for text in noise(60):
        assert coder.encode(pa.array([text], pa.large_string()))[1].tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, sf_dir, odd_docs, no_docs):
    library = piece_tokenizer(tokenizer_path("piece_bpe_32k.model")).library
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect()}
    for key, text in texts_of(spark, sf_dir):
        n = len(library.encode(text or ""))
        assert got[key] == (len((text or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(odd_docs).count() == odd_docs.count()
    assert token_counts.count_tokens(no_docs).count() == 0


def check_packing(rows, texts, size=2048):
    library = json_tokenizer(tokenizer_path("word_bpe_49k.json")).library
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[key], key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    held = []
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        held.append(at)
    return held


def test_packing(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = texts_of(spark, sf_dir)
    held = check_packing(packing.pack(docs).collect(), texts)
    assert sum(held) / (2048 * len(held)) > 0.95
    # Many tasks, so that leftovers are merged over several rounds.
    held = check_packing(packing.pack(docs.repartition(50), most=4, fan_in=4).collect(), texts)
    assert sum(held) / (2048 * len(held)) > 0.85
    assert packing.pack(no_docs).count() == 0
    rows = packing.pack(odd_docs).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.start == 0 for r in rows) == odd_docs.count()


def test_open_windows_best_fit_and_emission():
    w = packing.OpenWindows(10, 2)
    assert [w.place(n) for n in (7, 6, 3, 4)] == [(0, 0), (1, 0), (0, 7), (1, 6)]
    assert [w.place(n) for n in (6, 5, 9)] == [(2, 0), (3, 0), (4, 0)]
    assert [window for _, window in w.open] == [4, 3]  # window 2 was the fullest


@pytest.mark.parametrize("ids", [
    [], [0], [1] * 500, list(range(300)), [2**60 - 1, 5, 2**64 - 1, 2**63, 0], [0] * 127 + [2**61], [3, 2**62] * 200,
])
def test_simple8b_round_trip(ids):
    words, first = token_binary.encode(np.array(ids, np.uint64))
    assert token_binary.decode(words, first.astype(np.int64), len(ids)).tolist() == ids


def test_simple8b_random_round_trip_and_groups():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 1000))
        ids = rng.integers(0, 1 << 62, n, dtype=np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
        words, first = token_binary.encode(ids)
        assert (token_binary.decode(words, first.astype(np.int64), n) == ids).all()
        ends = [*first[1:].tolist(), len(words)]
        g = len(first) // 2  # a group alone
        part = token_binary.decode(words[first[g] : ends[g]], np.zeros(1, np.int64), min(128, n - 128 * g))
        assert (part == ids[128 * g : 128 * g + 128]).all()
    tokens = rng.integers(0, 32768, 100_000).astype(np.uint64)
    assert len(token_binary.encode(tokens)[0]) < len(tokens) / 3.8


def test_token_files(spark, sf_dir, odd_docs, no_docs):
    library = json_tokenizer(tokenizer_path("byte_bpe_50k.json")).library
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_binary.encode_documents(docs).collect()}
    at = 0
    for key, text in texts_of(spark, sf_dir):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[key] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = token_binary.encode_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    assert token_binary.encode_documents(no_docs).count() == 0
