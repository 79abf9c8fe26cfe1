"""Token ids in files of length-delimited records, with an offset index beside each.

A record: its payload's length (8 bytes), the masked CRC-32C of these 8 bytes, the payload, the
masked CRC-32C of the payload, all little-endian. A payload: a byte that tells whether there is
an id, the id (8 bytes), the width of a token (2 or 4 bytes), the tokens. The index of
``x.records`` is ``x.index``: the offset of every record and the end (8 bytes each), then their
masked CRC-32C. So a reader gets any record with two short reads.

Documents are dealt by ranges of doc_id and sorted, so the shards in order hold ascending ids.
Each task writes shards under names of its own; only names in the manifest, which Spark commits,
count. A task that runs twice or is lost leaves files nobody reads.

Defined results: null and empty texts have the end id alone. Null ids come first. Repeated rows
are records of their own, in an order of their texts' hashes. An empty table gives no shards. Other columns are not read.

Scale: texts are shuffled once; a shard is closed at ``SHARD_BYTES``; places of shards come from a running
sum over the manifest, which has one row per shard; shards are read back one by one.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgate.session import arrow_file_system, qualified, stage, staging_path

from .common import table
from .crc32c import crc32c, masked
from .tokens import Cache, Memo, load_tokenizer

END_ID = 1
SHARD_BYTES = 32 << 20
READ_BYTES = 16 << 20
MANIFEST = "part int, shard int, path string, records bigint, tokens bigint"

# A letter or digit of this range, then a full stop or comma, then a separator: a sure token boundary.
_STOP = re.compile(r"(?<=[A-Za-z0-9ß-öø-ÿ])(?=[.,][ \n])")
# Beyond these, lower case and composition are left to the library.
_FOREIGN = re.compile(r"[^\x00-įı-ɏ]")


def lowered(text: str | None) -> str:
    text = text or ""
    # a special string's case matters
    return text if "<|" in text or _FOREIGN.search(text) else text.lower()


def word_pieces(text: str | None) -> list[str]:
    """Pieces of a text for a tokenizer that lower-cases and drops white space: their ids in a row are the text's."""
    return _STOP.sub(" ", lowered(text)).replace("\n", " ").split(" ")


# A word of these letters is one pre-token and no normaliser changes it, so the library's model may be asked at once.
_WORD = re.compile(r"[a-zß-öø-ÿ]+")
_PROBES = ["the", "été", "straßen", "ñandúes", "zzzqxj", "øyåþ"]
# Such a word and signs up to the end of a piece: the signs are a pre-token of their own.
_TAILED = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
_TAILS = [",", "...", "'", "!'\"", "%%%", "-", "_", "$+<"]


def byte_characters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


_BYTES = byte_characters()


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizers library, with a cache of pieces."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.cache, self.model = Cache(), self.tokenizer.model
        # whether this vocabulary's model takes words as it is asked here
        self.direct = [self._of_word(p) for p in _PROBES] == self._of_any(_PROBES)
        tailed = self._of_any([p + t for p in _PROBES for t in _TAILS])
        self.tailed = self.direct and tailed == [self._of_word(p) + t for p in _PROBES for t in self._of_any(_TAILS)]
        self.counted = Memo(self._count)

    def _tokens(self, word: str) -> list:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return self.model.tokenize(word)

    def _of_word(self, word: str) -> bytes:
        return np.array([t.id for t in self._tokens(word)], self.dtype).tobytes()

    def _of_any(self, pieces: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in made]

    def _make(self, pieces: list[str]) -> list[bytes]:
        word = _WORD.fullmatch if self.direct else lambda p: None
        others = [p for p in pieces if not word(p)]
        rest = iter(self._of_any(others) if others else ())
        return [self._of_word(p) if word(p) else next(rest) for p in pieces]

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        split = [word_pieces(t) for t in texts]
        known = self.cache.fill((p for s in split for p in s), self._make)
        end = np.array([end_id], self.dtype).tobytes()
        return [b"".join([*map(known.__getitem__, s), end]) for s in split]

    def _count(self, piece: str) -> int:
        if self.direct and _WORD.fullmatch(piece):
            return len(self._tokens(piece))
        found = _TAILED.fullmatch(piece) if self.tailed else None
        if found:
            return len(self._tokens(found[1])) + self.counted[found[2]]
        return len(self._of_any([piece])[0]) // self.width

    def counts(self, texts: list[str | None]) -> list[int]:
        """Numbers of the ids of texts, without an end; ids are not kept."""
        known = self.counted.__getitem__
        return [sum(map(known, lowered(t).replace("\n", " ").split(" "))) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    """One data file and its index."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = arrow_file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.system, self.path = system, path
        self.out = system.open_output_stream(path)
        self.offsets, self.tokens = [0], 0

    def write(self, payloads: list[bytes], tokens: int) -> None:
        lengths = [struct.pack("<Q", len(p)) for p in payloads]
        crcs = crc32c([*lengths, *payloads])
        frames = []
        for k, (length, payload) in enumerate(zip(lengths, payloads)):
            frames += [length, struct.pack("<I", masked(crcs[k])), payload, struct.pack("<I", masked(crcs[len(lengths) + k]))]
            self.offsets.append(self.offsets[-1] + len(payload) + 16)
        self.out.write(b"".join(frames))
        self.tokens += tokens

    def close(self) -> None:
        self.out.close()
        offsets = np.array(self.offsets, "<u8").tobytes()
        with self.system.open_output_stream(self.path.removesuffix(".records") + ".index") as index:
            index.write(offsets + struct.pack("<I", masked(crc32c([offsets])[0])))


def payload_of(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width = struct.unpack_from("<?qB", payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=10)


def read_index(uri: str) -> np.ndarray:
    """The offsets of a shard's records, and its end."""
    system, path = arrow_file_system(uri.removesuffix(".records") + ".index")
    with system.open_input_file(path) as f:
        data = f.read()
    if len(data) < 12 or struct.unpack("<I", data[-4:])[0] != masked(crc32c([data[:-4]])[0]):
        raise ValueError(f"the index of {uri} is damaged")
    return np.frombuffer(data[:-4], "<u8").astype(np.int64)


def payloads(frames: list[bytes], uri: str) -> list[bytes]:
    """The payloads of whole records; damage is an error."""
    heads, bodies = [f[:8] for f in frames], [f[12:-4] for f in frames]
    crcs = crc32c([*heads, *bodies])
    for k, frame in enumerate(frames):
        length, head_crc = struct.unpack_from("<QI", frame)
        body_crc = struct.unpack("<I", frame[-4:])[0]
        if length != len(bodies[k]) or head_crc != masked(crcs[k]) or body_crc != masked(crcs[len(frames) + k]):
            raise ValueError(f"record {k} of {len(frames)} read from {uri} is damaged")
    return bodies


def read_records(uri: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """(id, tokens) of the records with these numbers, in the order asked for: a shuffled read."""
    offsets = read_index(uri).tolist()
    system, path = arrow_file_system(uri)
    with system.open_input_file(path) as f:
        frames = [f.read_at(offsets[n + 1] - offsets[n], offsets[n]) for n in numbers]
    return [parsed(p) for p in payloads(frames, uri)]


def scan_shard(uri: str, read_bytes: int = READ_BYTES) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """All records of a shard in order, some at a time."""
    offsets = read_index(uri)
    system, path = arrow_file_system(uri)
    with system.open_input_file(path) as f:
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + read_bytes, "right")) - 1)
            data, base = f.read_at(int(offsets[to] - offsets[at]), int(offsets[at])), offsets[at]
            cuts = (offsets[at : to + 1] - base).tolist()
            yield [parsed(p) for p in payloads([data[a:b] for a, b in zip(cuts, cuts[1:])], uri)]
            at = to


def write_records(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode ``docs`` into shards below ``folder``; the manifest (one row per shard), with each shard's first place."""
    uri = qualified(docs.sparkSession, folder).rstrip("/")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        part, made, shard = TaskContext.get().partitionId(), [], None
        encode = encoder(tokenizer_path)
        attempt = uuid.uuid4().hex

        def close():
            shard.close()
            made.append((part, len(made), shard.uri, len(shard.offsets) - 1, shard.tokens))

        for batch in batches:
            ids = encode.encode(batch.column("text").to_pylist(), end_id)
            if not ids:
                continue
            if shard is None:
                shard = ShardWriter(f"{uri}/part-{part:05d}-{attempt}-{len(made):05d}.records")
            keys = batch.column("doc_id").to_pylist()
            shard.write([payload_of(k, encode.width, i) for k, i in zip(keys, ids)], sum(map(len, ids)) // encode.width)
            if shard.offsets[-1] >= shard_bytes:
                close()
                shard = None
        if shard is not None:
            close()
        columns = zip(*made) if made else [[]] * 5
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        names = ["part", "shard", "path", "records", "tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    manifest = stage(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("bigint")))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the shards of a manifest."""
    shards = manifest.select("path", "start").repartition(max(1, min(manifest.count(), 10_000)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                for records in scan_shard(path):
                    out = []
                    for doc_id, ids in records:
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_records(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    folder = staging_path(spark, "records")
    return read_shards(write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path))
