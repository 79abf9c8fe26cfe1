"""SimHash near-dedup by multi-index hashing.

A fingerprint has a bit set if more than half of the text's shingle hashes have it set. Two
fingerprints link at ``MAX_BITS`` (4) or fewer differing bits. Of two linked fingerprints one
of the two 32-bit halves differs in at most 2 bits, so the balls of radius 1 around those
halves share a key: each fingerprint puts 33 keys per half into the table, equal keys are
fetched together, and every pair fetched is verified on all 64 bits.

Defined results: no words (null, empty or blank text) give fingerprint zero, which links like
any other. Rows with equal fingerprints are one node, so repeated rows and copies cost nothing
more. A null doc_id takes part in links; ``component_id`` is the smallest id that isn't null,
and null if there is none. An empty table gives an empty result. Other columns are not read.

Scale: texts are read once and never shuffled. Distinct fingerprints and their 66 keys (about a
kilobyte each) are shuffled by key. A task streams over sorted keys and holds ``BUCKET``
fingerprints at most; the rows of a larger bucket go to a second round, dealt out by pairs of
blocks. A bucket returns a spanning forest of its links, so a group of G near copies gives
fewer than G rows per bucket, not all pairs, and no link between components is lost. Results
stay exact at any bucket size.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import LOWER, encoded, over_batches, table
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BUCKET = 1024
_HASHES = 65_536  # hashes whose bits are counted at once


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; fewer words are one run."""
    words = encoded(text).translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    # no Python code per shingle
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8").astype(np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        part = hashes[at : at + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        return [batch.column(0), [fingerprint(t, size) for t in batch.column(1).to_pylist()]]

    return over_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, fp bigint")


_FLIPS = np.array([0, *(1 << k for k in range(32))], np.uint64)


def ball_keys(fps: np.ndarray) -> np.ndarray:
    """(n, 66) keys: both halves, each with at most one bit changed; bit 32 tells the halves apart."""
    fps = fps.astype(np.uint64)
    low, high = fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)
    return np.concatenate([low[:, None] ^ _FLIPS, (high[:, None] ^ _FLIPS) | np.uint64(1 << 32)], axis=1).astype(np.int64)


def keyed(fps: DataFrame) -> DataFrame:
    """66 rows (key, fp) per fingerprint."""

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 1000):
                part = values[at : at + 1000].view(np.uint64)
                keys = ball_keys(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part.view(np.int64), keys.shape[1]))], names=["key", "fp"]
                )

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def forest(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links at ``max_bits`` or fewer bits that connect what is connected among these; none to spare."""
    values = fps.view(np.uint64)
    near = np.empty((len(values), len(values)), bool)
    for at in range(0, len(values), 256):
        near[at : at + 256] = np.bitwise_count(values[at : at + 256, None] ^ values[None, :]) <= max_bits
    left, ones, twos = np.ones(len(values), bool), [], []
    while left.any():
        front = [int(left.argmax())]
        left[front] = False
        while front:
            node = front.pop()
            new = np.flatnonzero(near[node] & left)
            left[new] = False
            front += new.tolist()
            ones += [int(fps[node])] * len(new)
            twos += fps[new].tolist()
    return ones, twos


_ROUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("block", pa.int64())])


def _round(u, v=None, key: int | None = None, block: int | None = None) -> pa.RecordBatch:
    """Links (u, v), or fingerprints u of a block of a large bucket."""
    columns = [u, v if v is not None else [None] * len(u), [key] * len(u), [block] * len(u)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ROUND)


class _Bucket:
    """Fingerprints under one key; with a limit, those of a larger bucket go on as blocks."""

    def __init__(self, key: tuple, max_bits: int, limit: int | None):
        self.key, self.max_bits, self.limit = key, max_bits, limit
        self.held: list[np.ndarray] = []
        self.rows = self.blocks = 0

    def add(self, values: np.ndarray):
        self.held.append(values)
        self.rows += len(values)
        if self.limit is not None and self.rows > self.limit:
            yield from self._hand_on()

    def _hand_on(self):
        values = np.concatenate(self.held) if self.held else np.empty(0, np.int64)
        for at in range(0, len(values), self.limit):
            yield _round(values[at : at + self.limit], None, self.key[0], self.blocks)
            self.blocks += 1
        self.held, self.rows = [], 0

    def close(self):
        if self.blocks:
            yield from self._hand_on()
        elif self.rows > 1:
            u, v = forest(np.unique(np.concatenate(self.held)), self.max_bits)
            if u:
                yield _round(u, v)


def _links(keys: list[str], max_bits: int, limit: int | None):
    """For rows sorted by ``keys``: the links of each bucket, and the blocks of larger ones."""

    def run(batches):
        bucket = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, fps = [batch.column(n).to_numpy() for n in keys], batch.column("fp").to_numpy()
            change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            starts = np.array([0, *(np.flatnonzero(change) + 1)])
            ends = np.array([*starts[1:], len(fps)])
            # buckets of two inside this batch, by far the most that have any pair: all at once
            inner = np.arange(1, len(starts) - 1)
            twos = starts[inner[(ends - starts)[inner] == 2]]
            a, b = fps[twos], fps[twos + 1]
            near = (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits) & (a != b)
            if near.any():
                yield _round(a[near], b[near])
            more = inner[(ends - starts)[inner] > 2].tolist()
            for k in [0, *more, *([len(starts) - 1] if len(starts) > 1 else [])]:
                key = tuple(int(c[starts[k]]) for c in columns)
                if bucket is not None and bucket.key != key:
                    yield from bucket.close()
                    bucket = None
                bucket = bucket or _Bucket(key, max_bits, limit)
                yield from bucket.add(fps[starts[k] : ends[k]])
        if bucket is not None:
            yield from bucket.close()

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect all fingerprints which links at ``max_bits`` or fewer bits connect.

    fps: distinct fingerprints in column fp.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("two halves with one changed bit each reach 4 differing bits, not more")
    schema = "u bigint, v bigint, key bigint, block bigint"
    # a fingerprint becomes a kilobyte of keys, so many tasks make them
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    dealt = keyed(spread).repartition("key").sortWithinPartitions("key")
    first = stage(dealt.mapInArrow(_links(["key"], max_bits, bucket), schema), "links")
    large = first.filter("key IS NOT NULL").select("key", "block", F.col("u").alias("fp"))
    edges = first.filter("key IS NULL").select("u", "v")
    if large.isEmpty():
        return edges.distinct()
    blocks = large.groupBy("key").agg(F.max("block").alias("top"))
    pairs = large.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "top")))
    pairs = pairs.filter("top = 0 OR block <> other").select(
        "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "fp"
    )
    again = pairs.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    second = again.mapInArrow(_links(["key", "one", "two"], max_bits, None), schema)
    return edges.union(second.select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    rows = stage(fingerprints(docs, size), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits))
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    nodes = nodes.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = nodes.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows without an id cannot be told apart by the decision and stay. Rows that repeat both id
    and text are one row in the result.
    """
    kept = near_duplicates(docs, size, max_bits).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "leftsemi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
