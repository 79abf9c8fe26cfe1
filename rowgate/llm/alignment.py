"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

A text's tokens of tokenizer A and of tokenizer B are rows of token-by-byte incidence matrices in CSR form (row starts and
columns; every value is 1). The Gustavson row product A·Bᵀ walks the bytes of each A token and gathers the B
tokens that hold them: the overlap links, with the number of bytes shared. Two neighbouring A tokens that no
B token spans have a cut between them; the cuts make the groups. The product of the two token-by-group matrices gives the links:
all pairs of tokens that share a group. Products are made by blocks of rows of at most ``PRODUCTS`` entries
(a row that has more is a block of its own).

A is a byte-level BPE of the tokenizers library and reads a blank and the text; B is a sentencepiece BPE, which adds that
blank itself. Neither joins characters across the places where texts are cut into pieces here, so each piece is
encoded by its library once per worker and cached. ``count_links`` counts, over all documents, how many hold a pair of ids linked.

Defined results: a text that is null or empty, or whose tokens' bytes differ from a blank and the text (for B one that holds U+2581),
has no tokens: all its numbers are 0 and its groups ''. Strings of special tokens are plain text. Repeated rows count as documents of
their own; null and repeated ids give one result per row. An empty table gives an empty result. Other columns are not read.

Scale: texts are read and encoded once and never shuffled; each document's distinct linked pairs are staged. Counts are
summed per task before a shuffle. Pairs that many documents hold, ``FREQUENT`` at most (chosen by a histogram of counts in
powers of two), are looked up in a broadcast table; the others are joined by pair, where no pair is in more documents than the
least of the frequent ones.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import arrow_schema, table
from .token_counts import pre_tokens
from .tokens import CACHE_ENTRIES, CACHED_LENGTH, load_tokenizer

PRODUCTS = 1 << 20
PART_CHARS = 1 << 20  # of texts whose pieces are looked up together
FREQUENT = 1 << 18
_SPACED = re.compile(r" +[^ ]*")


class Csr(NamedTuple):
    """A matrix of ones: row ``i`` has the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_runs(cls, lengths: np.ndarray) -> Csr:
        """Rows that hold consecutive runs of columns: tokens and their bytes, or groups and their tokens."""
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_owners(cls, owners: np.ndarray, width: int) -> Csr:
        """Rows of one column each: bytes and their tokens, or tokens and their groups."""
        return cls(np.arange(len(owners) + 1), owners, width)


def row_products(left: Csr, right: Csr):
    """(rows, columns, values) of left·right by Gustavson's method, a block of rows at a time, in order of rows and columns."""
    begins, ends = right.starts[left.columns], right.starts[left.columns + 1]
    widths = ends - begins  # what each entry of the left matrix gathers
    made = np.concatenate([[0], np.cumsum(widths)])
    before = made[left.starts]  # products made before each row
    row, rows = 0, len(left.starts) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(before, before[row] + PRODUCTS, "right")) - 1)
        a, b = left.starts[row], left.starts[last]
        if before[last] - before[row] == b - a and (widths[a:b] == 1).all():
            columns = right.columns[begins[a:b]]
        else:
            of_entry = np.repeat(np.arange(a, b), widths[a:b])
            columns = right.columns[np.arange(before[row], before[last]) - made[of_entry] + begins[of_entry]]
        of_row = np.repeat(np.arange(row, last), before[row + 1 : last + 1] - before[row:last])
        same_row = of_row[1:] == of_row[:-1]
        steps = columns[1:] - columns[:-1]
        if (same_row & (steps < 0)).any():
            order = np.lexsort((columns, of_row))
            of_row, columns = of_row[order], columns[order]
            same_row, steps = of_row[1:] == of_row[:-1], columns[1:] - columns[:-1]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(columns)), bool), ~same_row | (steps != 0)]))
        yield of_row[first], columns[first], np.diff(np.append(first, len(columns)))
        row = last


class Side:
    """One tokenizer: packed ids of a text's pieces, byte lengths and decimal names of its ids."""

    def __init__(self, entries: list[bytes], encode):
        self.entries, self.encode = entries, encode
        self.known: dict[str, bytes] = {}
        self.lengths = np.array([len(e) for e in entries], np.int64)

    def _make(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of pieces; of those whose ids do not give back their bytes a mark instead."""
        entry, made = self.entries.__getitem__, {}
        for piece, ids in zip(pieces, self.encode(pieces)):
            whole = b"".join(map(entry, ids)) == piece.encode()
            made[piece] = struct.pack(f"<{len(ids)}i", *ids) if whole else b"?"
        return made

    def ids(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Ids of texts given by their pieces; the pieces that are not known yet are encoded at once."""
        pieces = list(chain.from_iterable(texts))
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        packed = list(map(self.known.get, pieces))
        missing = list(compress(range(len(pieces)), map(not_, packed)))
        if missing:
            fresh = self._make(list({pieces[i] for i in missing}))
            for i in missing:
                packed[i] = fresh[pieces[i]]
            self.known.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHED_LENGTH)
        out, at = [], 0
        for text in texts:
            part = packed[at : at + len(text)]
            at += len(text)
            out.append(None if b"?" in part else np.frombuffer(b"".join(part), "<i4"))
        return out


def byte_level_characters() -> dict[str, int]:
    """Byte-level vocabularies print a byte as its Latin-1 character if that is visible, else as one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def byte_level_side(path: str) -> Side:
    tokenizer, byte = load_tokenizer(path), byte_level_characters()
    tokenizer.encode_special_tokens = True
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    entries = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]
    return Side(entries, lambda pieces: [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])


def sentencepiece_side(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(count)]
    entries = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    blank = [model.piece_to_id("▁")]

    def encode(pieces: list[str]) -> list[list[int]]:
        # the model puts the first blank of a piece there itself, but not where nothing follows
        found = model.encode([p[1:] for p in pieces], num_threads=1) if pieces else []
        return [blank if p == " " else ids for p, ids in zip(pieces, found)]

    return Side(entries, encode)


class Aligner:
    """Aligns texts under two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level_side(path_a), sentencepiece_side(path_b)
        # names with what may follow them in the text of groups
        names_a, names_b = ([str(i) for i in range(len(s.entries))] for s in (self.a, self.b))
        self.names = [n + e for names, ends in ((names_a, ",|"), (names_b, ",;")) for e in ends for n in names]

    def align(self, text: str | None) -> dict:
        return self.align_all([text])[0]

    def align_all(self, texts: list[str | None]) -> list[dict]:
        """Ids and groups of both sides' tokens, overlap links and linked id pairs, of each text."""
        whole = [" " + text if text else "" for text in texts]
        of_a = self.a.ids([pre_tokens(w) for w in whole])
        of_b = self.b.ids([_SPACED.findall(w) for w in whole])
        return [self._aligned(a, b) if w and a is not None and b is not None else self._nothing() for w, a, b in zip(whole, of_a, of_b)]

    @staticmethod
    def _nothing() -> dict:
        none = np.empty(0, np.int64)
        return {"a": none, "b": none, "group_a": none, "group_b": none, "n_groups": 0, "overlaps": [none] * 3, "n_links": 0, "pairs": none, "times": none}

    def _aligned(self, a: np.ndarray, b: np.ndarray) -> dict:
        bytes_a = Csr.of_runs(self.a.lengths[a])
        of_byte = Csr.of_owners(np.repeat(np.arange(len(b)), self.b.lengths[b]), len(b))
        overlaps = [np.concatenate(parts) for parts in zip(*row_products(bytes_a, of_byte))]
        rows, columns, _ = overlaps
        # rows come in order and each one's columns do, so a row's first and last entries are its B tokens' ends
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        first, last = columns[starts], columns[np.append(starts[1:], len(rows)) - 1]
        group_a = np.cumsum(np.concatenate([[False], first[1:] != last[:-1]]))
        group_b = np.empty(len(b), np.int64)
        group_b[columns] = group_a[rows]
        n_groups = int(group_a[-1]) + 1
        in_group_a = Csr.of_owners(group_a, n_groups)
        of_group = Csr.of_runs(np.bincount(group_b, minlength=n_groups))
        keys, times, n_links = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for rows, columns, values in row_products(in_group_a, of_group):
            n_links += int(values.sum())
            found, counts = np.unique((a[rows].astype(np.int64) << 32) | b[columns], return_counts=True)
            if not len(keys):
                keys, times = found, counts
                continue
            keys, inverse = np.unique(np.concatenate([keys, found]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([times, counts])).astype(np.int64)
        return {"a": a, "b": b, "group_a": group_a, "group_b": group_b, "n_groups": n_groups, "overlaps": overlaps, "n_links": n_links, "pairs": keys, "times": times}

    def groups_text(self, found: dict) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, A's before B's."""
        a, b, group_a, group_b = (found[k] for k in ("a", "b", "group_a", "group_b"))
        if not len(a):
            return ""
        ends_a = np.concatenate([group_a[1:] != group_a[:-1], [True]])
        ends_b = np.concatenate([group_b[1:] != group_b[:-1], [True]])
        count_a, count_b = len(self.a.entries), len(self.b.entries)
        named = np.empty(len(a) + len(b), np.int64)
        # a token stands behind all tokens of earlier groups, and B's behind A's of the same group
        until_a = np.append(0, np.flatnonzero(ends_a) + 1)
        until_b = np.append(0, np.flatnonzero(ends_b) + 1)
        named[np.arange(len(a)) + until_b[group_a]] = a + ends_a * count_a
        named[np.arange(len(b)) + until_a[group_b + 1]] = 2 * count_a + b + ends_b * count_b
        return "".join(map(self.names.__getitem__, named.tolist()))[:-1]


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two vocabularies; a worker loads it once."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


_SCHEMAS = {
    "n_a": "bigint",
    "n_b": "bigint",
    "n_groups": "bigint",
    "n_overlaps": "bigint",
    "n_links": "bigint",
    "groups": "string",
    "a_ids": "array<int>",
    "b_ids": "array<int>",
    "a_groups": "array<int>",
    "b_groups": "array<int>",
    "overlaps": "array<struct<a:int,b:int,bytes:int>>",
    "links": "array<struct<pair:bigint,times:int>>",
}


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *parts])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind.value_type)).cast(kind)


def _structs(parts: list[list[np.ndarray]], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *(len(p[0]) for p in parts)], dtype=np.int32)
    columns = [np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in range(kind.value_type.num_fields)]
    fields = list(kind.value_type)
    flat = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets), flat).cast(kind)


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in parts of about ``PART_CHARS`` characters, or of one text that is longer."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def align_texts(docs: DataFrame, path_a: str, path_b: str, columns: tuple[str, ...] = tuple(_SCHEMAS)) -> DataFrame:
    """``doc_id`` and the named columns per row of ``docs``.

    ``overlaps`` are the pairs of token places that share bytes, ``links`` the distinct linked id pairs (A's id times
    2^32 plus B's) and how often each is linked in the text; ``groups`` is their text.
    """
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {_SCHEMAS[c]}" for c in columns)])
    arrow = arrow_schema(schema)

    def column(name, found, kind):
        if name in ("n_groups", "n_links"):
            return pa.array([f[name] for f in found], kind)
        if name in ("n_a", "n_b"):
            return pa.array([len(f[name[2]]) for f in found], kind)
        if name == "n_overlaps":
            return pa.array([len(f["overlaps"][0]) for f in found], kind)
        if name == "groups":
            return pa.array([aligner(path_a, path_b).groups_text(f) for f in found], kind)
        if name == "overlaps":
            return _structs([f["overlaps"] for f in found], kind)
        if name == "links":
            return _structs([[f["pairs"], f["times"]] for f in found], kind)
        key = {"a_ids": "a", "b_ids": "b", "a_groups": "group_a", "b_groups": "group_b"}[name]
        return _lists([f[key] for f in found], kind)

    def run(batches):
        align_all = aligner(path_a, path_b).align_all
        for batch in batches:
            found: list[dict] = []
            for part in _parts(batch.column(1).to_pylist()):
                found += align_all(part)
            made = [column(name, found, arrow.field(name).type) for name in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def count_links(links: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each pair linked, and whether no pair of its A id is in more.

    The highest count per A id has as many rows as the vocabulary has ids.
    """
    counts = links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = stage(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_frequent(counts: DataFrame, entries: int) -> int:
    """The least power of two that at most ``entries`` pairs reach."""
    by_size = counts.groupBy(F.floor(F.log2("n") + F.lit(1e-9)).cast("int").alias("size")).count()
    least, taken = 62, 0
    for row in sorted(by_size.collect(), reverse=True):  # one row per power of two
        taken += row["count"]
        if taken > entries:
            break
        least = row["size"]
    return 1 << least


def score_links(rows: DataFrame, row: str = "row", entries: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum): over the links of each row, those at their A id's highest count, and the counts' sum.

    ``rows`` is a staged table of ``row``, a unique number, and ``links``. Rows without links are left out.
    """
    links = rows.select(row, F.inline("links"))
    counts = stage(count_links(links), "counts")
    least = _least_frequent(counts, entries)
    # at most ``entries`` rows
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    rest = links.join(frequent, "pair", "left_anti").join(counts.where(F.col("n") < least), "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    both = links.join(frequent, "pair").groupBy(row).agg(*sums).unionByName(rest.groupBy(row).agg(*sums))
    return both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Counts and digests of the alignment of every text, and how common its links are."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
        path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    numbers = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
    aligned = align_texts(table(spark, sf_dir, "documents"), path_a, path_b, (*numbers, "groups", "links"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = stage(aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", *numbers, digest, "links"), "aligned")
    scored = rows.drop("links").join(score_links(rows), "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return scored.select("doc_id", *numbers, *zero, "groups_sha256")
