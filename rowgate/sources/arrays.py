"""Files that hold one JSON array each, read by ranges of bytes.

What a range does to the state of a scan (inside a string, behind an odd run of backslashes, depth of brackets) is a small table:
for each of four start states the state after it and the change of depth. Tables of a file's ranges are made
by as many tasks as there is data, and composed from its first byte on. Each range then knows where it stands and gives
out the elements that begin in it, reading on where one ends behind it. A file of one range needs no tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_file_system, qualified, stage
from .inputs import InputGroup
from .order import ORDER

RANGE_BYTES = 8 << 20
_BATCH_BYTES = 8 << 20
# Read as one range, by one task: there is no way into the middle of them.
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".br")
_BLANK = b" \t\n\r"
_ELEMENTS = T.StructType([T.StructField("seq", ORDER), T.StructField("raw", T.StringType())])

# A value of an array of bytes is the byte's sign as a bracket; commas are told by themselves.
_SIGN = np.zeros(256, np.int64)
_SIGN[[ord("["), ord("{")]] = 1
_SIGN[[ord("]"), ord("}")]] = -1


def _quotes(codes: np.ndarray, escaped: int) -> tuple[np.ndarray, int]:
    """Places of the quotes that are not escaped, and whether the byte behind the last one is."""
    quotes = np.flatnonzero(codes == ord('"'))
    slashes = np.flatnonzero(codes == ord("\\"))
    if not len(slashes):
        return quotes[1:] if escaped and len(quotes) and quotes[0] == 0 else quotes, escaped if not len(codes) else 0
    begins = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    lengths = np.diff(np.append(begins, len(slashes)))
    after = slashes[begins] + lengths
    if escaped and slashes[0] == 0:
        lengths[0] -= 1  # the first one is escaped itself
    behind = after[lengths % 2 == 1]
    if escaped and slashes[0] != 0:
        behind = np.append(0, behind)
    return quotes[~np.isin(quotes, behind)], int(len(behind) and behind[-1] == len(codes))


def moves(data: bytes) -> list[tuple[int, int, int]]:
    """(inside, escaped, change of depth) after ``data`` for the start states (0, 0), (0, 1), (1, 0), (1, 1)."""
    codes = np.frombuffer(data, np.uint8)
    brackets = np.flatnonzero(_SIGN[codes])
    found = []
    for inside in (0, 1):
        for escaped in (0, 1):
            quotes, behind = _quotes(codes, escaped)
            outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
            found.append(((inside + len(quotes)) % 2, behind, int(_SIGN[codes[brackets[outside]]].sum())))
    return found


def _separators(data: bytes, inside: int, escaped: int, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Places and bytes of what parts elements (the outer brackets, commas between them), and the state after ``data``."""
    codes = np.frombuffer(data, np.uint8)
    quotes, behind = _quotes(codes, escaped)
    places = np.flatnonzero((_SIGN[codes] != 0) | (codes == ord(",")))
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    signs = _SIGN[codes[places]]
    after = depth + np.cumsum(signs)
    parts = ((signs == 0) & (after == 1)) | ((signs == 1) & (after == 1)) | ((signs == -1) & (after == 0))
    state = (inside + len(quotes)) % 2, behind, int(after[-1]) if len(after) else depth
    return places[parts], codes[places[parts]], state


def elements(data: bytes, inside: int, escaped: int, depth: int, more: Callable[[], bytes], problem: ValueError) -> Iterator[str]:
    """The elements that begin in ``data``, as they are written; ``more`` gives what follows in the file."""
    decoder = json.JSONDecoder()
    places, kinds, state = _separators(data, inside, escaped, depth)
    if depth < 0 or (depth == 0 and data[: places[0] if len(places) else len(data)].strip(_BLANK)):
        raise problem
    for k, (place, kind) in enumerate(zip(places.tolist(), kinds.tolist())):
        if kind not in b"[,]" or (kind == ord("[")) != (k == 0 and depth == 0):
            raise problem
        begin, end = place + 1, int(places[k + 1]) if k + 1 < len(places) else None
        if kind == ord("]"):
            if data[begin:].strip(_BLANK):
                raise problem
            return
        closing = kinds[k + 1] if end is not None else None
        text = data[begin:end]
        if end is None:
            parts = [text]
            while closing is None:
                following = more()
                if not following:
                    raise problem
                found, closings, state = _separators(following, *state)
                closing = closings[0] if len(found) else None
                parts.append(following[: found[0]] if len(found) else following)
            text = b"".join(parts)
        text = text.strip(_BLANK).decode("utf-8", "replace")
        if not text and kind == ord("[") and closing == ord("]"):
            continue
        try:
            whole = decoder.raw_decode(text)[1] == len(text)
        except ValueError:
            whole = False
        if not whole:
            raise problem
        yield text


def _problem(file: str) -> ValueError:
    return ValueError(f"expected a JSON array in {file}")


def _read(path: str, start: int, size: int) -> tuple[bytes, Callable[[], bytes]]:
    """The bytes of a range, and a function that gives the next ones of the file."""
    system, place = arrow_file_system(path)
    if path.endswith(_PACKED):
        with system.open_input_stream(place) as stream:
            return stream.read(), lambda: b""
    file, step = system.open_input_file(place), [1 << 16]
    file.seek(start)

    def more() -> bytes:
        step[0] = min(2 * step[0], RANGE_BYTES)
        return file.read(step[0])

    return file.read(size), more


def _batches(numbered: Iterator[tuple[dict, str]]) -> Iterator[pa.RecordBatch]:
    order = pa.struct([("input", pa.int32()), ("file", pa.string()), ("block", pa.int64()), ("row", pa.int64())])
    schema, held, size = pa.schema([("seq", order), ("raw", pa.string())]), [], 0
    for seq, raw in numbered:
        held.append({"seq": seq, "raw": raw})
        size += len(raw)
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _elements_of_ranges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for row in frame.to_pylist():
            data, more = _read(row["path"], row["start"], row["size"])
            problem = _problem(row["file"])
            if row["start"] == 0 and not data.strip(_BLANK) and not more():
                raise problem
            seq = {"input": row["input"], "file": row["file"], "block": row["start"]}
            found = elements(data, row["inside"], row["escaped"], row["depth"], more, problem)
            yield from _batches(({**seq, "row": k}, text) for k, text in enumerate(found))


def _elements_of_texts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for row in frame.to_pylist():
            found = elements((row["raw"] or "").encode(), 0, 0, 0, lambda: b"", _problem(row["seq"]["file"]))
            if not row["raw"].strip():
                raise _problem(row["seq"]["file"])
            yield from _batches(({**row["seq"], "row": k}, text) for k, text in enumerate(found))


def _moves_of_ranges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        rows = []
        for row in frame.to_pylist():
            data = _read(row["path"], row["start"], row["size"])[0]
            first = data.lstrip(_BLANK)[:1].decode("latin-1")
            rows.append({"path": row["path"], "start": row["start"], "first": first, "moves": [n for m in moves(data) for n in m]})
        kinds = [("path", pa.string()), ("start", pa.int64()), ("first", pa.string()), ("moves", pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _composed(tables: pd.DataFrame) -> pd.DataFrame:
    """The state before each range of one file, by going through its tables in order."""
    tables = tables.sort_values("start")
    problem, states = _problem(tables["path"].iloc[0]), []
    inside = escaped = depth = 0
    opened = False
    for first, table in zip(tables["first"], tables["moves"]):
        if first and depth == 0 and inside == 0 and (opened or first != "["):
            raise problem
        opened = opened or bool(first)
        states.append((inside, escaped, depth))
        inside, escaped, change = table[3 * (2 * inside + escaped) :][:3]
        depth += change
    if not opened or inside or depth:
        raise problem
    made = pd.DataFrame(states, columns=["inside", "escaped", "depth"])
    return made.assign(path=tables["path"].to_numpy(), start=tables["start"].to_numpy())


def _dealt(ranges: DataFrame, size: int, count: int) -> DataFrame:
    """Ranges over as many tasks as a scan of their bytes would have."""
    spark = ranges.sparkSession
    a_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return ranges.repartition(max(1, -(-size // a_task), min(count, spark.sparkContext.defaultParallelism)))


def read_array_elements(spark: SparkSession, group: InputGroup, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(seq, raw) of the elements of every array file of ``group``."""
    files = group.scan(spark.read.format("binaryFile"), F.struct("path", "length").alias("f"), F.lit(0), F.lit(0))
    files = files.select("seq.input", "seq.file", "f.path", "f.length")
    packed = F.lit(False)
    for suffix in _PACKED:
        packed = packed | F.col("path").endswith(suffix)
    count = F.when(packed, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes)))
    files = files.withColumn("ranges", count.cast("bigint"))
    total = files.agg(F.sum("length").alias("size"), F.sum("ranges").alias("n"), F.max("ranges").alias("most")).first()
    size, n = total["size"] or 0, total["n"] or 0
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ranges") - 1)).alias("k"))
    ranges = ranges.select("input", "file", "path", (F.col("k") * range_bytes).alias("start"), F.lit(range_bytes).cast("bigint").alias("size"), "ranges")
    states = [F.lit(0).alias("inside"), F.lit(0).alias("escaped"), F.lit(0).cast("bigint").alias("depth")]
    names = ["input", "file", "path", "start", "size"]
    known = ranges.where("ranges = 1").select(*names, *states)
    if (total["most"] or 0) > 1:
        long = ranges.where("ranges > 1")
        tables = _dealt(long.select("path", "start", "size").distinct(), size, n).mapInArrow(
            _moves_of_ranges, "path string, start bigint, first string, moves array<bigint>"
        )
        # a row of a hundred bytes for each range of a file
        composed = tables.groupBy("path").applyInPandas(_composed, "path string, start bigint, inside int, escaped int, depth bigint")
        placed = long.join(stage(composed, "array-states"), ["path", "start"])
        known = known.unionByName(placed.select(*names, "inside", "escaped", "depth"))
    return _dealt(known, size, n).mapInArrow(_elements_of_ranges, _ELEMENTS)


def read_array_texts(spark: SparkSession, group: InputGroup) -> DataFrame:
    """The same where only Spark can read the files: each is one text, split by one task."""
    texts = group.scan(spark.read.format("text").option("wholetext", True), F.col("value").alias("raw"), F.lit(0), F.lit(0))
    return texts.drop("input_ord").mapInArrow(_elements_of_texts, _ELEMENTS)


def reads_ranges(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open files of this file system at any place."""
    try:
        arrow_file_system(qualified(spark, path))
    except (OSError, ValueError, NotImplementedError):
        return False
    return True
