from __future__ import annotations

import os
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowgate.llm import records
from rowgate.llm.crc32c import _plain, crc32c, masked
from rowgate.llm.records import Encoder, op3_records, read_index, read_records, read_shards, scan_shard, write_records
from rowgate.llm.token_counts import count_tokens, op8_token_counts, pre_tokens
from rowgate.llm.tokens import Cache, Memo

SF_DIR = "/root/testdata/sf0.01"
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
ENCODER = Encoder(WORDS)

chars = st.one_of(
    st.sampled_from(list(" \n\t\r.,'’*#0149abZéßÀİıſΣςǅﬁ漢א") + ["́", "̸", "\x1c", "\x85", "\xa0", " ", "　", "\x00"]),
    st.characters(codec="utf-8"),
)
pieces = st.one_of(chars, st.sampled_from(["word", " The", "'s", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "  ", "\n\n", ", ", ". ", "é"]))
texts = st.lists(pieces, max_size=25).map("".join)


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_ids_are_the_library_s(text):
    expected = LIBRARY[WORDS].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode([text], 1)[0], "<u2").tolist() == [*expected, 1]


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_counts_are_the_library_s(text):
    library = LIBRARY[BYTES]
    split = pre_tokens(text, ("<|endoftext|>",))
    assert "".join(split) == text
    total = sum(len(library.encode(p, add_special_tokens=False).ids) for p in split)
    assert total == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_numbers_of_ids_are_the_library_s(text):
    expected = LIBRARY[WORDS].encode(text, add_special_tokens=False).ids
    assert ENCODER.counts([text, None, text]) == [len(expected), 0, len(expected)]


def test_counting_asks_once_and_keeps_no_ids(monkeypatch):
    """Signs after words, known and new, are counted apart from them; the rest goes to the library once."""
    encoder, asked = Encoder(WORDS), []
    of_any = encoder._of_any
    monkeypatch.setattr(encoder, "_of_any", lambda pieces: asked.extend(pieces) or of_any(pieces))
    words = [a + b for a in ("wort", "été", "straße", "mot") for b in "abcdefghijklmnopqrstuvwxyz"]
    text = "\n".join(w + tail for w in words for tail in ("", ",", ".%%%", "***", "!'")) + " 555-1234 a@b.cd"
    expected = len(LIBRARY[WORDS].encode(text, add_special_tokens=False).ids)
    assert encoder.counts([text, text.upper().replace("SS", "ß")]) == [expected] * 2
    assert sorted(asked) == sorted([",", ".%%%", "***", "!'", "555-1234", "a@b.cd"])
    assert not encoder.cache.young and not encoder.cache.old


def test_memo_stays_small():
    made = []
    memo = Memo(lambda p: made.append(p) or len(p), 10)
    for k in range(30):
        assert memo["again"] == 5 and memo[f"p{k}"] == len(f"p{k}")
        assert len(memo) <= 5 and len(memo.old) <= 5
    assert made.count("again") == 1 and len(made) == 31
    assert memo["z" * 65] == 65 == memo["z" * 65] and made.count("z" * 65) == 2


def test_crc32c():
    assert crc32c([b"123456789", b"", b"abc"]) == [0xE3069283, 0, _plain(b"abc")]
    rng = np.random.default_rng(0)
    parts = [rng.bytes(n) for n in (4, 8, 255, 256, 257, 1000, 5000)]
    assert crc32c(parts) == [_plain(p) for p in parts]
    assert masked(0) == 0xA282EAD8


def test_cache_stays_small():
    cache, made = Cache(10), []
    for k in range(100):
        out = cache.fill([f"p{k}", "always", "x" * 100], lambda m: made.append(len(m)) or [len(p) for p in m])
        assert out == {f"p{k}": len(f"p{k}"), "always": 6, "x" * 100: 100}
        assert len(cache.young) + len(cache.old) <= 12
    assert sum(made) < 230


def test_records_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    start, expected = 0, []
    for doc_id, text in docs:
        ids = [*LIBRARY[WORDS].encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, op3_records(spark, SF_DIR).collect())) == expected


def test_counts_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op8_token_counts(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(LIBRARY[BYTES].encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


@pytest.fixture
def odd(spark):
    rows = [(None, None, 1), (7, "", 2), (3, "same text", 3), (3, "same text", 4), (-1, "x <|endoftext|> y", 5), (9, "word " * 50_000, 6)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, start bigint")


def test_records_of_odd_rows(spark, odd, tmp_path):
    manifest = write_records(odd, str(tmp_path / "out"), WORDS, shard_bytes=1)
    found = sorted(map(tuple, read_shards(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, -1, 3, 3, 7, 9]
    assert [r[2] for r in found] == [1, 4, 3, 3, 1, 50_001]
    assert [r[1] for r in found] == [0, 1, 5, 8, 11, 12]
    again = write_records(odd.repartition(5), str(tmp_path / "again"), WORDS)
    assert sorted(map(tuple, read_shards(again).collect()), key=lambda r: r[1]) == found
    assert read_shards(write_records(odd.limit(0), str(tmp_path / "none"), WORDS)).count() == 0


def test_shuffled_reads_and_damage(spark, odd, tmp_path):
    path = write_records(odd.filter("doc_id <> 9").coalesce(1), str(tmp_path), WORDS).first()["path"]
    every = [r for part in scan_shard(path, read_bytes=1) for r in part]
    order = list(reversed(range(len(every))))
    again = read_records(path, order)
    assert [r[0] for r in again] == [every[n][0] for n in order]
    assert all((a[1] == every[n][1]).all() for a, n in zip(again, order))
    assert len(read_index(path)) == len(every) + 1
    file = path.removeprefix("file:")
    data = bytearray(open(file, "rb").read())
    data[30] ^= 1
    os.chmod(file, 0o644)
    open(file, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(scan_shard(path))
    with pytest.raises(ValueError, match="damaged"):
        data[0] ^= 1
        records.payloads([bytes(data[:30])], path)


def test_counts_of_odd_rows(spark, odd):
    rows = Counter(map(tuple, count_tokens(odd, BYTES, entries=3, sample_rows=2).collect()))
    assert rows == Counter([(None, 0, 0), (7, 0, 0), (3, 9, 2), (3, 9, 2), (-1, 17, 4), (9, 250_000, 50_001)])
    assert count_tokens(odd.limit(0), BYTES).count() == 0
