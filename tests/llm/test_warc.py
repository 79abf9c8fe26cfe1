from __future__ import annotations

import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rowgate.llm import warc
from rowgate.llm.warc import DamagedRecord, chunked, members, parsed, read_archives, reassembled, unchunked, write_archives


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(payload, size):
    assert unchunked(chunked(payload, size)) == payload


def test_chunk_forms():
    assert unchunked(b"3;x=1\r\nabc\r\nA \r\n0123456789\r\n0\r\nT: v\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"3\r\nab", b"x\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n", b"0\r\nT: v\r\n"):
        with pytest.raises(DamagedRecord):
            unchunked(bad)


def test_segments_are_put_in_order_and_checked():
    parts = [(2, None, {}, b"b"), (3, 3, {}, b"c"), (1, None, {"a": "1"}, b"a")]
    assert reassembled(parts) == ({"a": "1"}, b"abc")
    for bad in (parts[:2], parts[::2], [*parts, parts[0]], [(1, None, {}, b"a")], [(1, None, {}, b"a"), (2, 9, {}, b"b")]):
        with pytest.raises(DamagedRecord):
            reassembled(bad)


ROWS = [
    (1, "http://h/1", "x" * 1000),
    (5, "http://h/5", "x" * 1000),
    (3, "http://h/3\r\nX: y", "x" * 1000),
    (3, "http://h/3", "x" * 1000),
    (8, None, "y" * 999),
    (9, "u", "y" * 999),
    (None, "u", "x" * 1000),
    (None, "u", "n" * 2000),
    (None, "u", "n" * 2000),
    (11, "u", None),
    (12, "u", ""),
    (13, "é", "ü\r\n\r\n" * 30_000),
    (2, "u", "ü\r\n\r\n" * 30_000),
]


def expected(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        if page_id is not None:
            groups[html].append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = max(groups[html], default=None)
        again = len(data) >= 1000 and first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "'r' AS refers_to", "1 AS digest")


@pytest.mark.parametrize("segment", [50, 777, 1 << 20])
def test_round_trip(spark, pages, tmp_path, segment):
    manifest = write_archives(pages, str(tmp_path), segment_bytes=segment, archive_bytes=500)
    rows = read_archives(manifest, with_payload=True).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected(ROWS)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in rows if r.record_type == "response")
    kinds = Counter()
    for r in manifest.collect():
        with open(r.path.removeprefix("file:"), "rb") as f:
            data = f.read()
        assert gzip.decompress(data).startswith(b"WARC/1.1")
        kinds.update(parsed(m)[0]["warc-type"] for m in members(io.BytesIO(data), 7))
    assert kinds["response"] == 8 and kinds["revisit"] == 5 and (kinds["continuation"] > 0) == (segment < 1 << 20)


def test_damage_is_an_error(spark, pages, tmp_path):
    manifest = write_archives(pages, str(tmp_path), segment_bytes=400)
    for row in manifest.collect():
        path = row["path"].removeprefix("file:")
        with open(path, "rb") as f:
            kept = list(members(f))
        with open(path, "wb") as f:
            f.write(b"".join(gzip.compress(m) for m in kept if b"WARC-Segment-Number: 2\r" not in m))
    with pytest.raises(Exception, match="segment"):
        read_archives(manifest).collect()


def test_no_rows(spark, pages, tmp_path):
    assert read_archives(write_archives(pages.limit(0), str(tmp_path))).count() == 0
    assert warc.digest_of(warc.digest_label("00" * 20)) == "00" * 20
