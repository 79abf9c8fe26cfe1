"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens at places where the vocabulary's own split pattern must cut too,
so the text's count is the sum of its pre-tokens' counts. First tier: a table of the most
frequent pre-tokens and their lengths, sent to every task; ``FREQUENT`` entries at most. Second tier: a cache in
each Python worker for the rest, of bounded size, filled by the library. Pre-tokens are never
shuffled; only those of at most ``SAMPLE_ROWS`` documents (chosen by a hash) are counted to choose the
table's entries, which decide on speed and not on results.

Defined results: null and empty texts have no bytes and no tokens. Strings of special tokens in
a text are handled as the library does by default: one token each. Rows are never grouped, so
repeated rows and null ids give one result each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, over_batches, table
from .tokens import Cache, load_tokenizer

LIMIT = 512
FREQUENT = 50_000
SAMPLE_ROWS = 2_000

# White space of the split pattern.
_WS = r"\t-\r \x85\xa0  -     　"
# Letters of this range up to an ASCII character or the end; else up to white space; else the pattern's own rules.
_PIECE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7f])"
    rf"| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)


def pre_tokens(text: str | None, special: tuple[str, ...] = ()) -> list[str]:
    """Pre-tokens of a text; strings of special tokens are pre-tokens, and end what stands before them."""
    text = text or ""
    if not any(s in text for s in special):
        return _PIECE.findall(text)
    parts = re.split("|".join(f"({re.escape(s)})" for s in sorted(special, key=len, reverse=True)), text)
    return [p for part in parts if part for p in ([part] if part in special else _PIECE.findall(part))]


class PieceCounter:
    """Token counts of pre-tokens by the library, with a worker's cache."""

    def __init__(self, path: str):
        self.tokenizer, self.cache = load_tokenizer(path), Cache()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def frequent_lengths(
    docs: DataFrame, tokenizer_path: str, entries: int = FREQUENT, sample_rows: int = SAMPLE_ROWS
) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample."""
    total = docs.count()
    rows = docs.select("doc_id", "text")
    if total > sample_rows:
        share = int(sample_rows / total * (1 << 31))
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)

    special = counter(tokenizer_path).special

    def work(batch):
        counts = Counter(p for t in batch.column("text").to_pylist() for p in pre_tokens(t, special) if len(p) <= 64)
        return [list(counts), list(counts.values())]

    counted = over_batches(rows, work, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in counted.orderBy(F.col("n").desc(), "piece").limit(entries).collect()]
    return dict(zip(top, counter(tokenizer_path).lengths(top))) if top else {}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, entries: int = FREQUENT, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``docs``."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, entries, sample_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        first, second = frequent.value, counter(tokenizer_path)
        texts = batch.column(1).to_pylist()
        counts = []
        for text in texts:
            pieces = pre_tokens(text, second.special)
            lengths = list(map(first.get, pieces))
            if None in lengths:
                missing = [p for p, n in zip(pieces, lengths) if n is None]
                known = second.cache.fill(missing, second.lengths)
                counts.append(sum(n for n in lengths if n is not None) + sum(map(known.__getitem__, missing)))
            else:
                counts.append(sum(lengths))
        return [batch.column(0), [len(encoded(t)) for t in texts], counts]

    return over_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
