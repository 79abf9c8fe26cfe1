"""WARC archives: pages out as segmented records, and records back by segment reassembly.

Writing: each page is a record whose block is an HTTP response with a chunked body. Of equal payloads
of at least ``LEAST_REVISIT`` bytes the page with the largest id is the response, the others are revisit
records that refer to it. A block longer than ``SEGMENT_BYTES`` is cut into segments: the first is the
response record, the rest are continuation records that name it as their origin, count up, and give the total length
in the last one. Archives are gzip files with one member per record; archive files take turns, so the segments of a record
may lie in several of them.

Reading: every record of every archive becomes a row; continuation records are grouped by
their origin, ordered by segment number, and checked against numbers and total length; then the
chunked framing of the body is decoded and the payload is checked against its digest.

Defined results: null html is an empty payload. A null page_id is never the response if another copy
has an id; where no copy has one, all are responses. Repeated rows of one id and payload are all
responses or all revisits. Line breaks in a url are escaped. An empty table gives no archives.
Other columns are not read.

Scale: only ids, lengths and digests are grouped to find copies, on the map side first, so a third of all
pages may be one payload. Pages are joined with revisits on their own ids. Records in one piece are decoded where they are
read; only segments are shuffled, by origin, and put together one origin at a time. Archives count only if the manifest,
which Spark commits, names them, so a task that runs twice or is lost does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.session import arrow_file_system, qualified, stage, staging_path

from .common import arrow_schema, table

LEAST_REVISIT = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 32 << 20
TURNS = 2  # archives that a task writes side by side
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedRecord(ValueError):
    """An archive does not hold what its records say."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)[ \t]*(?:;.*)?", body[at:end] if end >= 0 else b"")
        if not size:
            raise DamagedRecord("a chunk has no size")
        length, at = int(size[1], 16), end + 2
        if not length:
            break
        if body[at + length : at + length + 2] != b"\r\n":
            raise DamagedRecord("a chunk does not end where it should")
        parts.append(body[at : at + length])
        at += length + 2
    while body[at : at + 2] != b"\r\n":  # trailers, then an empty line
        at = body.find(b"\r\n", at) + 2
        if at < 2:
            raise DamagedRecord("a chunked body has no end")
    return b"".join(parts)


def digest_label(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def digest_of(label: str) -> str:
    kind, _, value = label.partition(":")
    if kind != "sha1":
        raise DamagedRecord(f"unknown digest {kind}")
    return base64.b32decode(value).hex()


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_records(page_id, url, payload: bytes, digest: str, refers_to, name: str, segment_bytes: int) -> list[bytes]:
    """The record of a page, or its segments in order."""
    url = None if url is None else "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-Id", page_id), ("WARC-Payload-Digest", digest_label(digest))]
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, *more], head)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common]
    if len(block) <= segment_bytes:
        return [record(kind, block)]
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [record([*kind, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<{name}/{number}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", f"<{name}>"),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None),
        ]
        out.append(record(headers, part))
    return out


def with_revisits(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html (binary), digest and refers_to: the response's id for pages that are revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1("html"))
    slim = rows.select("page_id", "digest", F.length("html").alias("size")).filter(F.col("size") >= least_revisit)
    slim = stage(slim.groupBy("page_id", "digest").agg(F.lit(1).alias("one")).drop("one"), "payloads")
    first = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("ids"))
    copies = slim.join(first.filter("ids > 1"), "digest").filter("NOT (page_id <=> refers_to)")
    copies = copies.select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "refers_to")
    return rows.join(copies, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left").drop("of", "same")


class ArchiveWriter:
    def __init__(self, uri: str):
        self.uri, (system, path) = uri, arrow_file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.bytes, self.records = system.open_output_stream(path, compression=None), 0, 0

    def write(self, data: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.bytes += len(member)
        self.records += 1


MANIFEST = "path string, records bigint"


def write_archives(
    pages: DataFrame,
    folder: str,
    least_revisit: int = LEAST_REVISIT,
    segment_bytes: int = SEGMENT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages`` below ``folder``; the manifest, one row per archive."""
    uri = qualified(pages.sparkSession, folder).rstrip("/")

    def run(batches):
        attempt, part, made, turn, number = uuid.uuid4().hex, TaskContext.get().partitionId(), [], 0, 0
        open_now: list[ArchiveWriter] = []

        def close(writer):
            writer.out.close()
            made.append((writer.uri, writer.records))

        opened = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, payload, digest, refers_to = row
                number += 1
                for data in page_records(page_id, url, payload, digest, refers_to, f"urn:page:{page_id}:{attempt}.{number}", segment_bytes):
                    if len(open_now) < TURNS:
                        open_now.append(ArchiveWriter(f"{uri}/part-{part:05d}-{attempt}-{opened:05d}.warc.gz"))
                        opened += 1
                    turn = (turn + 1) % len(open_now)
                    open_now[turn].write(data)
                    if open_now[turn].bytes >= archive_bytes:
                        close(open_now.pop(turn))
        for writer in open_now:
            close(writer)
        columns = list(zip(*made)) if made else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["path", "records"])

    rows = with_revisits(pages, least_revisit).select("page_id", "url", "html", "digest", "refers_to")
    return stage(rows.mapInArrow(run, MANIFEST), "archives")


def members(stream, read_bytes: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip file, one after the other."""
    data = b""
    while True:
        data = data or stream.read(read_bytes)
        if not data:
            return
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            if not data:
                data = stream.read(read_bytes)
                if not data:
                    raise DamagedRecord("an archive ends inside a record")
            parts.append(packer.decompress(data))
            data = packer.unused_data
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise DamagedRecord("not a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise DamagedRecord("a record's length is wrong")
    return headers, rest[:length]


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a whole record."""
    page_id = int(headers["x-page-id"]) if "x-page-id" in headers else None
    digest = digest_of(headers["warc-payload-digest"])
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if headers["warc-type"] == "revisit":
        refers_to = int(headers["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
        return page_id, int(http[b"content-length"]), digest, "revisit", refers_to, None
    payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise DamagedRecord(f"the payload of page {page_id} is not the one that was written")
    return page_id, len(payload), digest, "response", None, payload


SEGMENTS = "origin string, number bigint, total bigint, headers map<string,string>, block binary, page struct<{}>"
PAGE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def reassembled(segments: list[tuple]) -> tuple[dict[str, str], bytes]:
    """Headers of the first and the whole block of an origin's segments (number, total, headers, block)."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise DamagedRecord("a segment is missing or comes twice")
    block, totals = b"".join(s[3] for s in segments), {s[1] for s in segments if s[1] is not None}
    if totals != {len(block)} or segments[-1][1] is None:
        raise DamagedRecord("the segments' total length is wrong")
    return dict(segments[0][2]), block


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per page in the archives of a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    fields = PAGE + ", payload binary" * with_payload
    names = [f.split()[0] for f in fields.split(", ")]
    schema = SEGMENTS.format(fields.replace(" ", ":").replace(",:", ","))
    archives = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))

    arrow = arrow_schema(schema)

    def table_of(rows):
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = arrow_file_system(path)
                rows, size = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for data in members(stream):
                        headers, block = parsed(data)
                        if "warc-segment-number" not in headers:
                            rows.append({"page": dict(zip(names, page_row(headers, block)))})
                        else:
                            total = headers.get("warc-segment-total-length")
                            rows.append(
                                {
                                    "origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]),
                                    "number": int(headers["warc-segment-number"]),
                                    "total": int(total) if total else None,
                                    "headers": list(headers.items()),
                                    "block": block,
                                }
                            )
                        size += len(data)
                        if size > 4 << 20:
                            yield table_of(rows)
                            rows, size = [], 0
                if rows:
                    yield table_of(rows)

    def join(batches):
        """Rows come sorted by origin and number."""
        held, origin, out, size = [], None, [], 0
        for batch in batches:
            for now, *segment in zip(*(c.to_pylist() for c in batch.columns)):
                if held and now != origin:
                    out.append(page_row(*reassembled(held)))
                    held = []
                    if size > 4 << 20:
                        yield of_pages(out)
                        out, size = [], 0
                origin = now
                size += len(segment[3])
                held.append(tuple(segment))
        if held:
            out.append(page_row(*reassembled(held)))
        yield of_pages(out)

    def of_pages(rows):
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        columns = [pa.array([r[k] for r in rows], types.get(n, pa.string())) for k, n in enumerate(names)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    # read once: whole pages and segments go to one staged table, and only segments are shuffled
    rows = stage(archives.mapInArrow(read, schema), "segments")
    whole = rows.filter("page IS NOT NULL").select("page.*")
    parts = rows.filter("page IS NULL").select("origin", "number", "total", "headers", "block")
    parts = parts.repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(parts.mapInArrow(join, fields))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), staging_path(spark, "warc"))
    return read_archives(manifest)


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> response THEN response END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
