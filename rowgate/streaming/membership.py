"""Which keys were accepted before: runs of keys in buckets, with a filter beside each bucket.

A run holds the keys of one batch, or of several that were merged: ``run=<first>-<last>-<bits>`` in the folder of
the state. Its keys lie in ``2**bits`` buckets by their first bits, about ``BUCKET_KEYS`` to a bucket, and each bucket has a Bloom
filter of 24 bits a key, which is a file of its own. Keys are hashes, so their bytes serve as hash values.

A batch's keys are probed against the filters of the buckets they fall into before any key is read; then only buckets are read for which
a filter said yes. So a batch reads at most one filter and one bucket per key and run, whatever the state holds, and a
run that has none of its keys is not read but for filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_file_system, delete_folder, qualified

BUCKET_KEYS = 65_536
MOST_BITS = 12
# So many runs of one level are merged into one of the next.
MERGED = 16
_BITS_A_KEY, _PROBES = 24, 16


class Run(NamedTuple):
    first: int
    last: int
    bits: int
    path: str


def _bucket(key: str, bits: int) -> Column:
    """The first bits of a key as a number."""
    first = F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int")
    return F.shiftright(first, 16 - bits).alias("bucket")


# filters


def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of the bits of 32-byte ``keys`` (a row each) in a filter of ``size`` words."""
    at, step = (np.ascontiguousarray(keys[:, a : a + 8]).view("<u8")[:, 0] for a in (8, 16))
    for _ in range(_PROBES):
        yield at % np.uint64(64 * size)
        at = at + (step | np.uint64(1))


def make_filter(keys: np.ndarray) -> np.ndarray:
    words = np.zeros(len(keys) * _BITS_A_KEY // 64 + 16, "<u8")  # not too few for a handful of keys
    for place in _places(keys, len(words)):
        np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` the filter's keys may hold; never no for one they do."""
    found = np.ones(len(keys), bool)
    for place in _places(keys, len(words)):
        found &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def _rows(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32)


# runs


def key_runs(spark: SparkSession, state: str, batch_id: int) -> list[Run]:
    """The runs that hold the keys of all batches before ``batch_id``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.listStatus(folder) if system.exists(folder) else []:
        named = re.fullmatch(r"run=([0-9]+)-([0-9]+)-([0-9]+)", status.getPath().getName())
        path = status.getPath().toString()
        if named and int(named[2]) < batch_id and system.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "keys/_SUCCESS")):
            found.append(Run(int(named[1]), int(named[2]), int(named[3]), path))
    # a merged run takes the place of those inside it, which may not be deleted yet
    return sorted(r for r in found if not any(o.first <= r.first and r.last <= o.last and o != r for o in found))


def write_run(spark: SparkSession, state: str, first: int, last: int, keys: DataFrame) -> None:
    """Write the keys of some batches as one run; a repeated write leaves the same files. No keys make no run.

    Filters come first: a run counts once its keys are there.
    """
    count, bits = keys.count(), 0
    if not count:
        return
    while bits < MOST_BITS and count >> bits > BUCKET_KEYS:
        bits += 1
    path = f"{qualified(spark, state).rstrip('/')}/run={first}-{last}-{bits}"
    delete_folder(spark, path)
    bucketed = keys.select("key", _bucket("key", bits))

    def write_filter(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        system, place = arrow_file_system(f"{path}/filters/{bucket}")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place, compression=None) as out:
            out.write(make_filter(_rows(rows["key"].tolist())).tobytes())
        return pd.DataFrame({"bucket": [bucket]})

    bucketed.groupBy("bucket").applyInPandas(write_filter, "bucket int").count()
    bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys")


def run_keys(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """All keys of ``runs``."""
    return spark.read.schema("key binary").option("recursiveFileLookup", "true").parquet(*[f"{r.path}/keys" for r in runs])


def merge_runs(spark: SparkSession, state: str, batch_id: int) -> None:
    """Merge runs of earlier batches: 16 of one level into one of the next, so that few are ever listed.

    Only batches before ``batch_id`` are merged, so a replay of ``batch_id`` never meets its own keys. A key is rewritten
    once per level. What a merge replaced is deleted after it has ended.
    """
    size = MERGED
    while batch_id and batch_id % size == 0:
        first, last = batch_id - size, batch_id - 1
        inside = [r for r in key_runs(spark, state, batch_id) if first <= r.first and r.last <= last]
        if len(inside) > 1:
            write_run(spark, state, first, last, run_keys(spark, inside))
            for run in inside:
                delete_folder(spark, run.path)
        size *= MERGED


def candidates(fresh: DataFrame, runs: list[Run]) -> DataFrame:
    """(run, bucket, key): keys of ``fresh`` that a filter does not rule out, by the places of ``runs``.

    Keys are dealt by their first bits, so a filter of a large run is read by one task.
    """

    def probe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, tuple[int, np.ndarray | None]] = {}  # the filter that each run's last keys fell into
        for frame in frames:
            texts = frame.column(0).to_pylist()
            keys = _rows(texts)
            prefix = keys[:, 0].astype(np.int32) << 8 | keys[:, 1]
            found: list[list] = [[], [], []]
            for number, run in enumerate(runs):
                buckets = prefix >> (16 - run.bits)
                for bucket in np.unique(buckets).tolist():
                    if loaded.get(number, (None, None))[0] != bucket:
                        loaded[number] = bucket, _load(f"{run.path}/filters/{bucket}")
                    words = loaded[number][1]
                    here = np.flatnonzero(buckets == bucket)
                    hits = here[may_hold(words, keys[here])] if words is not None else here[:0]
                    found[0] += [number] * len(hits)
                    found[1] += [bucket] * len(hits)
                    found[2] += [texts[i] for i in hits.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int32(), pa.int32(), pa.binary()))], ["run", "bucket", "key"])

    dealt = fresh.select("key").repartition(_bucket("key", MOST_BITS)).sortWithinPartitions("key")
    return dealt.mapInArrow(probe, "run int, bucket int, key binary")


def _load(path: str) -> np.ndarray | None:
    """A filter; None for a bucket that has no keys."""
    system, place = arrow_file_system(path)
    try:
        with system.open_input_stream(place, compression=None) as stream:
            return np.frombuffer(stream.read(), "<u8")
    except FileNotFoundError:
        return None


def candidate_folders(found: DataFrame, runs: list[Run]) -> list[str]:
    """The folders of the buckets that must be read; a run has at most 4,096."""
    return [f"{runs[r['run']].path}/keys/bucket={r['bucket']}" for r in found.select("run", "bucket").distinct().collect()]


def seen_keys(found: DataFrame, runs: list[Run]) -> DataFrame | None:
    """The keys among those that :func:`candidates` found which the runs do hold; None if no bucket need be read."""
    folders = candidate_folders(found, runs)
    if not folders:
        return None
    old = found.sparkSession.read.schema("key binary").parquet(*folders)
    return old.join(found.select("key").distinct(), "key", "left_semi").select("key").distinct()
