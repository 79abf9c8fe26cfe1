"""Byte-level BPE encoding and decoding by a tree of joins.

Encodings form a monoid: two neighbours join into the encoding of both. A text is halved down to ``CHUNK``
characters, whose pre-tokens the split pattern gives; a pre-token is halved down to ``LEAF`` bytes, which are merged
directly. Up the tree, neighbours join by encoding a window around their boundary anew, which grows until what
stands outside provably stays:

- Tokens: the first merge that crosses a boundary between two tokens depends on these two alone, so a row of tokens is
  the encoding of its bytes if each adjacent pair is the encoding of its own bytes. Pairs inside the window and outside
  of it hold already; the pairs at its two edges are tested.
- Pre-tokens: a match outside stays if the pattern looked at no character beyond the left text's end. The pattern never
  looks back, so from the first match on that begins where a match of the right text begins, those of the right text stay.

As in the library, a pre-token that is an entry itself is that token, whatever merging would give. Decoding concatenates
the halves' bytes.

Defined results: null and empty texts have no ids, and decode to no bytes; null ids decode to no bytes, and an unknown
id is an error. Strings of special tokens are plain text. Rows are never grouped or shuffled, so repeated rows, ties and
null ids of documents give one result each; an empty table gives an empty result. Other columns are not read. A text is
held by one task, as its row is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, encoded, over_batches, table
from .tokens import Cache

CHUNK = 4_096  # characters
LEAF = 16  # bytes
_DIRECT = 64  # bytes that a plain scan merges faster than a heap does
_IDS = 4_096  # ids that are decoded at once
_PAIRS = 1 << 18  # tested pairs of tokens that are remembered
# The pattern looks this far from a match's end (is a blank followed by something else?) and from its start (is it 're?).
_PAST_END, _PAST_START = 2, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Entries and their ranks of a file with a base64 entry and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines) if entry}


class ByteBpe:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.entries: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for entry, rank in ranks.items():
            self.entries[rank] = entry
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache = Cache()

    # pre-tokens

    def pre_tokens(self, text: str) -> list[str]:
        if len(text) <= CHUNK:
            return self.find(text)
        half = len(text) // 2
        return self.join_pre_tokens(self.pre_tokens(text[:half]), self.pre_tokens(text[half:]))

    def join_pre_tokens(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of both texts in a row, from the matches of each."""
        if not left or not right:
            return left + right
        kept, behind = len(left), 0  # behind: characters of the left text from match ``kept`` on
        while kept and (behind < _PAST_END or behind + len(left[kept - 1]) < _PAST_START):
            kept -= 1
            behind += len(left[kept])
        open_text, taken = "".join(left[kept:]), 1
        while True:
            taken = min(taken, len(right))
            window = open_text + "".join(right[:taken])
            starts, at = {}, len(open_text)
            for place, match in enumerate(right[:taken]):
                starts[at] = place
                at += len(match)
            found, at = [], 0
            for match in self.find(window):
                if at in starts:  # from here on the right text's own matches stay
                    return left[:kept] + found + right[starts[at] :]
                end = at + len(match)
                if taken < len(right) and max(end + _PAST_END, at + _PAST_START) > len(window):
                    break  # this match may be another one with more text
                found.append(match)
                at = end
            if taken == len(right):
                return left[:kept] + found
            taken *= 2

    # tokens of one pre-token

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes in a row, from the encoding of each."""
        if not left or not right:
            return left + right
        before = after = 1
        while True:
            before, after = min(before, len(left)), min(after, len(right))
            outside, beyond = left[: len(left) - before], right[after:]
            middle = self.merge(self.decode(left[len(left) - before :]) + self.decode(right[:after]))
            begins = not outside or self.stays(outside[-1], middle[0])
            ends = not beyond or self.stays(middle[-1], beyond[0])
            if begins and ends:
                return outside + middle + beyond
            before, after = before if begins else 2 * before, after if ends else 2 * after

    def stays(self, one: int, two: int) -> bool:
        """Whether two adjacent tokens are the encoding of their bytes."""
        known = self.pairs.get((one, two))
        if known is None:
            known = self.merge(self.entries[one] + self.entries[two]) == [one, two]
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[one, two] = known
        return known

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, the leftmost of equal ones, until no pair is an entry."""
        if len(piece) > _DIRECT:
            return self._merge_long(piece)
        rank, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        found = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            least, at = None, -1
            for i, r in enumerate(found):
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = rank(parts[at] + parts[at + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, for windows of any length."""
        rank, size = self.ranks.get, len(piece)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the part that begins at a place
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(size)
        while heap:
            _, at, stop = heapq.heappop(heap)
            second = end[at]
            if gone[at] or second >= size or end[second] != stop:
                continue  # one of the two has been merged since
            gone[second], end[at] = 1, stop
            if stop < size:
                before[stop] = at
                if (r := rank(piece[at : end[stop]])) is not None:
                    heapq.heappush(heap, (r, at, end[stop]))
            if before[at] >= 0 and (r := rank(piece[before[at] : stop])) is not None:
                heapq.heappush(heap, (r, before[at], stop))
        out, at = [], 0
        while at < size:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    # texts

    def _packed(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.encode_piece(p.encode()), "<u4").tobytes() for p in pieces]

    def encode(self, text: str | None) -> np.ndarray:
        pieces = self.pre_tokens(text or "")
        known = self.cache.fill(pieces, self._packed)
        return np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= _IDS:
            return b"".join(map(self.entries.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_loaded: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a file of ranks; a worker loads it once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    arrow = arrow_schema(schema)

    def run(batches):
        encode = codec(ranks_path, pattern).encode
        for batch in batches:
            rows = [encode(text) for text in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *rows]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(arrow.field("ids").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) per row of (doc_id, ids); the bytes are UTF-8 if the ids were a text's."""

    def work(batch):
        decode = codec(ranks_path, pattern).decode
        return [batch.column(0), [decode(ids or []) for ids in batch.column(1).to_pylist()]]

    kind = rows.schema["doc_id"].dataType.simpleString()
    return over_batches(rows.select("doc_id", "ids"), work, f"doc_id {kind}, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Digests of the ids of every text, and of the bytes that these ids decode to."""
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")

    def work(batch):
        decode, columns = codec(path, pattern).decode, [batch.column(0), [], [], []]
        for ids in batch.column(1):
            values = ids.values.to_numpy()
            columns[1].append(len(values))
            columns[2].append(hashlib.sha256(values.astype("<u4").tobytes()).hexdigest())
            columns[3].append(hashlib.sha256(decode(values.tolist())).hexdigest())
        return columns

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return over_batches(encode_texts(docs, path, pattern), work, schema)
