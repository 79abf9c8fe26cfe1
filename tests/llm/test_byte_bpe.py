from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgate.llm import byte_bpe
from rowgate.llm.byte_bpe import ByteBpe, decode_ids, encode_texts, load_ranks, op12_byte_bpe

SF_DIR = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = ByteBpe(RANKS, public_tokenizers.PATTERN)

pieces = st.one_of(
    st.sampled_from(["the", "'s", "'l", "'", "l", "  ", " ", "\n", "\t", "aaaa", "==", "é", "中文", "😀", "12", "<|endoftext|>", " "]),
    st.characters(codec="utf-8"),
)
texts = st.lists(pieces, max_size=40).map("".join)


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 4)
    monkeypatch.setattr(byte_bpe, "LEAF", 2)
    monkeypatch.setattr(byte_bpe, "_DIRECT", 6)
    monkeypatch.setattr(byte_bpe, "_IDS", 3)


def test_texts_as_the_library(small_leaves):
    @settings(max_examples=1500, deadline=None)
    @given(texts)
    def check(text):
        ids = CODEC.encode(text)
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert CODEC.decode(ids.tolist()) == text.encode()

    check()


def test_joins_are_associative(small_leaves):
    """Any cut of a text into three joins to the same matches, and any cut of bytes to the same tokens."""
    rng = random.Random(5)
    for _ in range(2000):
        parts = ["".join(rng.choice("ab' lé1\n") for _ in range(rng.randint(0, 9))) for _ in range(3)]
        a, b, c = (CODEC.find(p) for p in parts)
        join, whole = CODEC.join_pre_tokens, CODEC.find("".join(parts))
        assert join(join(a, b), c) == join(a, join(b, c)) == whole
        one, two, three = (CODEC.tree(p.encode()) for p in parts)
        join, whole = CODEC.join, CODEC.merge("".join(parts).encode())
        assert join(join(one, two), three) == join(one, join(two, three)) == whole


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 20_000, "=" * 30_000, " " * 40_000 + "x", "1" * 30_000, "ไทย" * 9000])
def test_long_runs_end(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_entries_that_merging_does_not_reach():
    """A pre-token that is an entry is that token, as in the library; inside a pre-token only merges count."""
    ranks = {**{bytes([b]): b for b in range(256)}, b"bc": 256, b"abc": 257, b"abcabc": 258, b"abab": 259}
    own, library = (ByteBpe(ranks, r"\w+|\W+"), tiktoken.Encoding("o", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={}))
    for text in ("abab", "ababab", "abcabc abab", "abababc", "abcabcabc"):
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op12_byte_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        ids = np.array(LIBRARY.encode_ordinary(text), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    long = "word é " * 60_000
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS ids", "'x' AS decoded", "1 AS n_tokens")
    encoded = encode_texts(docs, PATH, public_tokenizers.PATTERN)
    found = sorted((r.doc_id or 0, list(r.ids)) for r in encoded.collect())
    assert found == sorted((i or 0, LIBRARY.encode_ordinary(t or "")) for i, t in rows)
    decoded = decode_ids(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in decoded) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert [bytes(r.decoded) for r in decode_ids(nulls, PATH, public_tokenizers.PATTERN).collect()] == [b""]
