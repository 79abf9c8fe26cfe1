"""Best-fit packing into sequences, under conflicts.

A document is a run of tokens; runs longer than a bin are cut into full bins and a rest. Rests
go to bins by best fit in falling order of size: bins are kept in order of the room they have
left, the search starts at the bin with just enough room and goes on through its successors
until it comes to one without a conflict, which is the tightest that fits. Each bin carries two
bitmaps: the sources and the duplicate clusters of what it holds; a document conflicts with a bin
that has its cluster, or already ``PER_SOURCE`` pieces of its source. Full bins made by cutting
hold one document each.

Clusters are components of near duplicates, by fingerprints that differ in few bits (``simhash``), so near copies don't
share a bin either.

Shards: documents are dealt by a hash of id and cluster into shards of about ``SHARD_ROWS`` rows, each of
which is packed by one task; their number grows with the table, so tasks don't. Rows of equal id and cluster that are more than a
shard are dealt over as many shards as they fill. Bins are never shared by shards. A shard that by ill luck is larger is packed in
blocks of ``BLOCK_ROWS`` rows, so a task's memory is bounded; within a block source and cluster
numbers are the bits.

A token is one of the vocabulary whose path is given to ``measured``, without the end id (the query and the pipeline give that
of ``op3_records``); without a path it is a word.

Defined results: null and empty texts have no tokens and no cluster, and one piece of length 0 that goes into a
bin like any other. A null source or cluster conflicts with nothing. Repeated rows are separate
pieces that conflict by their cluster. Ties: longer first, then by id, cluster and source; of bins with
equal room the oldest. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import encoded, over_batches, table
from .components import components
from .records import encoder
from .simhash import fingerprint, links

CAPACITY = 2048
PER_SOURCE = 2
SHARD_ROWS = 4_000
BLOCK_ROWS = 20_000


class Bins:
    """Bins in order of room left, with bitmaps of what they hold."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (room left, bin), the successor search runs over it
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # k-th bitmap: sources with more than k pieces

    def put(self, size: int, source: int | None, cluster: int | None) -> int:
        """The bin of a piece: the tightest that has no conflict, or a new one."""
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        clusters, sources, top = self.clusters, self.sources, self.per_source - 1
        order = self.order
        for at in range(bisect_left(order, (size, -1)), len(order)):
            room, number = order[at]
            if not clusters[number] & c and not sources[number][top] & s:
                del order[at]
                break
        else:
            room, number = self.capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * self.per_source)
        clusters[number] |= c
        held = sources[number]
        for k in range(self.per_source):
            if not held[k] & s:
                held[k] |= s
                break
        insort(order, (room - size, number))
        return number


def pack(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """(row, start, length, bin) of each piece; rows are (id, tokens, source, cluster)."""
    numbers: tuple[dict, dict] = ({}, {})
    out, rests, full = [], [], 0
    for at, (_, tokens, source, cluster) in enumerate(rows):
        whole = tokens // capacity
        for k in range(whole):
            out.append((at, k * capacity, capacity, -1 - full))
            full += 1
        if tokens % capacity or not tokens:
            rests.append((at, whole * capacity, tokens - whole * capacity))
    key = [tuple((v is None, v if v is not None else 0) for v in (r[0], r[3], r[2])) for r in rows]
    rests.sort(key=lambda r: (-r[2], key[r[0]]))
    bins = Bins(capacity, per_source)
    for at, start, size in rests:
        _, _, source, cluster = rows[at]
        bits = [None if v is None else known.setdefault(v, len(known)) for v, known in zip((source, cluster), numbers)]
        out.append((at, start, size, bins.put(size, *bits)))
    used = len(bins.clusters)
    return [(at, start, size, used - 1 - number if number < 0 else number) for at, start, size, number in out]


def shards_of(rows: int, shard_rows: int) -> int:
    return max(1, -(-rows // shard_rows))


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(shard, block, bin, doc_id, start, length): every piece of every document.

    docs: doc_id, n_tokens, source, cluster (BIGINT, or null).
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("a bin must hold a token and a piece of a source")
    kind = docs.schema["doc_id"].dataType.simpleString()
    equal = docs.groupBy("doc_id", F.col("cluster").cast("bigint").alias("cluster")).agg(F.count("*").alias("n"))
    rows, most = equal.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    count, salt = shards_of(rows, shard_rows), F.lit(0).cast("bigint")
    if (most or 0) > shard_rows:
        docs, salt = _salted(docs, equal.where(F.col("n") > shard_rows), shard_rows), F.col("__salt")
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "cluster", salt), F.lit(count)).alias("shard"),
        "doc_id",
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("bigint").alias("cluster"),
    )
    # rows of a shard come together in a fixed order, whatever task reads them
    dealt = dealt.repartition(count, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "cluster", "source")
    schema = f"shard bigint, block bigint, bin bigint, doc_id {kind}, start bigint, length bigint"

    def run(batches):
        shard, block, held = None, 0, []

        def packed():
            pieces = pack(held, capacity, per_source)
            columns = [
                pa.array([shard] * len(pieces), pa.int64()),
                pa.array([block] * len(pieces), pa.int64()),
                pa.array([p[3] for p in pieces], pa.int64()),
                pa.array([held[p[0]][0] for p in pieces], batch.schema.field("doc_id").type),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "bin", "doc_id", "start", "length"])

        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("shard", "doc_id", "n_tokens", "source", "cluster")))
            for now, *row in rows:
                if held and (now != shard or len(held) >= block_rows):
                    yield packed()
                    block = block + 1 if now == shard else 0
                    held = []
                shard = now
                held.append(tuple(row))
        if held:
            yield packed()

    return dealt.mapInArrow(run, schema)


def _salted(docs: DataFrame, hot: DataFrame, shard_rows: int) -> DataFrame:
    """Rows with a number of the shard they are dealt to among those of equal id and cluster; staged, as that is by their order."""
    hot = hot.select(F.col("doc_id").alias("__id"), F.col("cluster").alias("__cluster"), F.ceil(F.col("n") / shard_rows).alias("__parts"))
    joined = docs.join(hot, [docs["doc_id"].eqNullSafe(hot["__id"]), docs["cluster"].eqNullSafe(hot["__cluster"])], "left")
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1)))
    return stage(joined.withColumn("__salt", part).drop("__id", "__cluster", "__parts"), "salted")


def token_counts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text, without the end id."""
    return encoder(path).counts(texts)


def measured(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, source, cluster) of ``docs``: tokens of the vocabulary, else words; the component of near duplicates.

    Fingerprints are those of the lower-case words, so texts equal up to case and white space are of one cluster.
    """
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        texts = batch.column("text").to_pylist()
        if tokenizer_path:
            sizes = token_counts(texts, tokenizer_path)
        else:
            sizes = [len(encoded(t).split()) for t in texts]
        return [batch.column("doc_id"), sizes, batch.column("source"), [fingerprint((t or "").lower()) for t in texts]]

    made = stage(over_batches(rows, work, f"doc_id {kind}, n_tokens bigint, source string, fp bigint"), "measured")
    roots = components(links(stage(made.select("fp").distinct(), "distinct")))
    joined = made.join(roots, made["fp"] == roots["node"], "left")
    cluster = F.when(F.col("n_tokens") > 0, F.coalesce("root", "fp")).alias("cluster")
    return joined.select("doc_id", "n_tokens", "source", cluster)


def bin_name() -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("shard", "block", "bin")])


def op7_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack_documents(measured(table(spark, sf_dir, "documents"), tokenizer_path))
    return pieces.select(bin_name().alias("bin_id"), "doc_id", "start", "length")
