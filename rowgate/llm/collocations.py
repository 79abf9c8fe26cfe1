"""Phrase collocations by the stripes pattern.

The stripe of a prefix is an associative counter of the words that follow it. One structure so gives extensions (a stripe's
entries), prefix totals (a prefix is itself an entry of the stripe of its first words, which counts all its occurrences; all words
are entries of the empty prefix, whose total is ``n``) and subsumption maxima (the largest entry of a phrase's own stripe, and the
entry of that phrase behind one more word).

Stripes are made for one prefix length after another. An entry is counted only where all words of its phrase but the last, and all
but the first, are phrases of the round before with at least ``LEAST`` occurrences; no other phrase can reach ``LEAST``. Tasks
ask a Bloom filter of those phrases, at most ``FILTER_BITS`` bits at any size of the corpus: it never denies one of them, and what it
lets pass in error is counted exactly and dropped. From three words on, only runs of three or more words are read again in
which every two neighbours pass.

Each task sums stripes over ``CHUNK_WORDS`` words before a shuffle. The stripe of a hot prefix, one that at least one of
``HOT`` words begins, is split over ``SLOTS`` keys by a hash of the next word (that of the empty prefix over ``FIRST_SLOTS``); as
each word begins one phrase of a length, no more than ``HOT`` prefixes of a length are hot, and the set is sent to tasks. Stripes of equal prefix and slot are merged entry by entry; entries below ``LEAST`` are then summed up into one.

Defined results: null and empty texts have no words; a null language is ``und``, together with documents of that name. Repeated rows
count again, ids do not matter and other columns are not read. An empty table gives an empty result. Ties of score go to the more frequent
phrase, then to the phrase that is less in UTF-8 byte order; equal phrases do not occur.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import LOWER, arrow_schema, encoded, over_batches, table

LEAST = 100
LONGEST = 5
TOP = 2_000
COVER = 100  # per cent of a phrase's occurrences that a longer one must have to take its place
CHUNK_WORDS = 1 << 22
_CHUNK_BYTES = 64 << 20
_BLOCK_WORDS = 1 << 13  # words of runs that are kept in one row
FIRST_SLOTS, SLOTS, HOT = 4_096, 64, 4_096
FILTER_BITS = 1 << 26
_BITS_EACH, _PROBES = 16, 4

# Ends of pieces become a byte that UTF-8 text never has; tabs become blanks.
_END = b"\xff"
_PIECES = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in LOWER)

# Next words are joined by blanks, which no word has.
_STRIPES = "lang string, prefix string, slot int, next string, n array<int>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text, with ``_END`` behind each piece."""
    return (encoded(text).translate(_PIECES).replace(_END, b" \xff ") + b" \xff").split()


# hashes of phrases, and the filter

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(state: np.ndarray, word_hashes: np.ndarray) -> np.ndarray:
    state = (state ^ word_hashes) * _PRIME
    return state ^ (state >> np.uint64(29))


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(_PROBES)]


def _lang_hash(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode())], np.uint64)


class Filter:
    """Phrases that are frequent, and some that aren't."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.bits = cells, len(cells) * 64

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in _probes(hashes, self.bits):
            cell = self.cells[(place >> np.uint64(6)).astype(np.int64)]
            found &= (cell >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def frequent_filter(phrases: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """The filter of a table (lang, phrase); its bits are set by tasks, and at most ``most_bits`` come to the driver."""
    bits = 1 << 10
    wanted = phrases.count() * _BITS_EACH
    while bits < wanted and bits < most_bits:
        bits *= 2

    def work(batch):
        hashes = []
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            state = _lang_hash(lang)
            for word in phrase.encode().split(b" "):
                state = _mixed(state, np.uint64(xxhash.xxh64_intdigest(word)))
            hashes.append(state)
        places = np.concatenate(_probes(np.concatenate(hashes), bits)) if hashes else np.empty(0, np.uint64)
        cells, inverse = np.unique(places >> np.uint64(6), return_inverse=True)
        values = np.zeros(len(cells), np.uint64)
        np.bitwise_or.at(values, inverse, np.uint64(1) << (places & np.uint64(63)))
        return [cells.astype(np.int64), values.view(np.int64)]

    set_bits = over_batches(phrases.select("lang", "phrase"), work, "cell bigint, bits bigint")
    rows = set_bits.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(bits // 64, np.uint64)
    cells[rows["cell"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(cells)


# stripes of a chunk of one language

class _Chunk:
    """Words of one language: their ids in order, 0 at the ends of pieces."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)
        self.ids[_END]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def sequence(self) -> tuple[np.ndarray, list[bytes]]:
        return np.concatenate(self.parts), list(self.ids)


def _passing(ids: np.ndarray, words: list[bytes], size: int, lang: str, known: Filter) -> np.ndarray:
    """Whether a phrase of ``size`` words that passes the filter begins at each place (with one place more, where none does)."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    places = max(0, len(ids) - size + 1)
    passing = np.zeros(len(ids) + 1, bool)
    inside, state = np.ones(places, bool), np.repeat(_lang_hash(lang), places)
    for k in range(size):
        word = ids[k : k + places]
        inside &= word != 0
        state = _mixed(state, hashes[word])
    passing[:places][inside] = known.has(state[inside])
    return passing


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _stripes(
    lang: str, ids: np.ndarray, words: list[bytes], size: int, known: Filter | None, hot: frozenset[str]
) -> list[pa.Array] | None:
    """Stripes of prefixes of ``size`` words, split if they are ``hot``: the columns of ``_STRIPES``."""
    total = len(words)
    if size == 0:
        at, following, rank = np.zeros(1, np.int64), ids[ids != 0], 0
    else:
        passing = _passing(ids, words, size, lang, known)
        # a prefix, and the phrase without its first word
        at = np.flatnonzero(passing[:-1] & passing[1:])
        following, rank = ids[at + size], ids[at]
        for k in range(1, size):
            rank = np.unique(rank * total + ids[at + k], return_inverse=True)[1]
    if not len(following):
        return None
    keys, counts = np.unique(rank * total + following, return_counts=True)
    prefix_of, word_of = keys // total, keys % total
    if size == 0:
        named, split = [b""], np.ones(1, bool)
    else:
        first = np.unique(rank, return_index=True)[1]
        named = [b" ".join([words[i] for i in ids[p : p + size].tolist()]) for p in at[first].tolist()]
        # prefixes by their places among those of this chunk
        prefix_of = np.searchsorted(rank[first], prefix_of)
        split = np.array([f"{lang}\0{name.decode()}" in hot for name in named], bool) if hot else np.zeros(len(named), bool)
    slot_of = np.zeros(len(keys), np.int64)
    dealt = split[prefix_of]
    hashed = {w: zlib.crc32(words[w]) % (SLOTS if size else FIRST_SLOTS) for w in np.unique(word_of[dealt]).tolist()}
    slot_of[dealt] = [hashed[w] for w in word_of[dealt].tolist()]
    if dealt.any():
        order = np.lexsort((word_of, slot_of, prefix_of))
        prefix_of, word_of, slot_of, counts = prefix_of[order], word_of[order], slot_of[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], (prefix_of[1:] != prefix_of[:-1]) | (slot_of[1:] != slot_of[:-1])]))
    offsets = pa.array(np.append(begins, len(counts)).astype(np.int32))
    following = pa.ListArray.from_arrays(offsets, _texts([b"", *words[1:]]).take(pa.array(word_of)))
    return [
        pa.array([lang] * len(begins)),
        _texts(named).take(pa.array(prefix_of[begins])),
        pa.array(slot_of[begins].astype(np.int32)),
        pc.binary_join(following, " "),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
    ]


def _runs(lang: str, ids: np.ndarray, words: list[bytes], known: Filter) -> list[pa.Array] | None:
    """Longest runs of three or more words in which every two neighbours pass, a line each, some thousand words to a row."""
    passing = _passing(ids, words, 2, lang, known)
    begins = np.flatnonzero(passing[:-1] & ~np.concatenate([[False], passing[:-2]]))
    ends = np.flatnonzero(passing[:-1] & ~passing[1:]) + 2
    long = ends - begins > 2
    found, block, held = [], [], 0
    for a, b in zip(begins[long].tolist(), ends[long].tolist()):
        block.append(b" ".join([words[i] for i in ids[a:b].tolist()]))
        held += b - a
        if held >= _BLOCK_WORDS:
            found.append(b"\n".join(block))
            block, held = [], 0
    if block:
        found.append(b"\n".join(block))
    return [pa.array([lang] * len(found)), _texts(found)] if found else None


def _by_chunks(docs: DataFrame, work, schema: str) -> DataFrame:
    """``work(lang, ids, words)`` over chunks of the words of each language, in every task."""
    arrow = arrow_schema(schema)

    def flush(chunks):
        for lang, chunk in chunks.items():
            columns = work(lang, *chunk.sequence())
            if columns is not None:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        chunks.clear()

    def run(batches):
        chunks, held, size = defaultdict(_Chunk), 0, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                words = words_of(text)
                chunks[lang].add(words)
                held, size = held + len(words), size + len(text)
                if held >= CHUNK_WORDS or size >= _CHUNK_BYTES:
                    yield from flush(chunks)
                    held = size = 0
        yield from flush(chunks)

    return docs.mapInArrow(run, schema)


# rounds

def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, slot, next, n): stripes merged entry by entry; those below ``least`` are one entry (NULL)."""
    key = ["lang", "prefix", "slot"]
    entries = stripes.repartition(*key).select(*key, F.inline(F.arrays_zip(F.split("next", " ").alias("next"), F.col("n").alias("n"))))
    # stripes stand together by their keys, so neither sum moves them
    summed = entries.groupBy(*key, "next").agg(F.sum("n").alias("n"))
    kept = F.when(F.col("n") >= least, F.col("next")).alias("next")
    return summed.groupBy(*key, kept).agg(F.sum("n").alias("n"))


def stripes_of(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Merged stripes of prefixes of 0 to ``longest`` - 1 words, staged."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rounds: list[DataFrame] = []
    for size in range(longest):
        known, hot = None, frozenset()
        if size:
            known = spark.sparkContext.broadcast(frequent_filter(extensions(rounds[-1])))
            hot = _hot(extensions(rounds[-1]), rounds[0].agg(F.sum("n")).first()[0])
            if size == 2:

                def runs(lang, ids, words, known=known):
                    return _runs(lang, ids, words, known.value)

                rows = stage(_by_chunks(rows, runs, "lang string, text string"), "runs")

        def work(lang, ids, words, size=size, known=known, hot=hot):
            return _stripes(lang, ids, words, size, known.value if known is not None else None, hot)

        rounds.append(stage(_merged(_by_chunks(rows, work, _STRIPES), least), f"stripes-{size}"))
    return rounds


def _hot(phrases: DataFrame, words: int | None) -> frozenset[str]:
    """Prefixes that begin at one of ``HOT`` words or more: ``HOT`` of them at most."""
    rows = phrases.where(F.col("n") * HOT >= (words or 0)).select("lang", "phrase").collect()
    return frozenset(f"{r['lang']}\0{r['phrase']}" for r in rows)


def extensions(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, n): prefixes with the words that follow them."""
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return stripes.where("next IS NOT NULL").select("lang", phrase.alias("phrase"), "prefix", "n")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to ``longest`` words of each language."""
    rounds = stripes_of(docs, least, longest)
    words = F.split("phrase", " ")
    found = [extensions(r) for r in rounds]
    candidates = found[1]
    for more in found[2:]:
        candidates = candidates.unionByName(more)
    parts = found[0].select("lang", "phrase", "n")
    for more in found[1:-1]:
        parts = parts.unionByName(more.select("lang", "phrase", "n"))
    # the largest count of a phrase with one more word; a still longer one has no more
    longer = candidates.where(F.size(words) > 2)
    inside = F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " ")
    covers = longer.select("lang", F.col("prefix").alias("phrase"), "n").unionByName(longer.select("lang", inside.alias("phrase"), "n"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = candidates.join(covers, ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(100 * F.col("most") < cover * F.col("n"), F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.withColumns(
        {
            "left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
            "right": F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " "),
        }
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(rounds[0].groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    # whole numbers of up to 38 digits; the quotient is below 1000 * n
    above, below = F.lit(1000).cast("decimal(4,0)") * _exact("a"), _exact("l") * _exact("r")
    cuts = cuts.withColumns({"above": (above.cast("decimal(22,0)") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)"), "below": below.cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_WORDS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k AS size, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 100),
"""
OP13_SQL = _WORDS + r"""
d AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.a >= 100 * c.a
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
s AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM d)),
m AS (
  SELECT s.lang, s.phrase, a, x.n AS l, y.n AS r, t.n,
    ((1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score, k
  FROM s JOIN f AS x ON x.lang = s.lang AND x.phrase = s.first JOIN f AS y ON y.lang = s.lang AND y.phrase = s.rest
  JOIN t ON t.lang = s.lang),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""
