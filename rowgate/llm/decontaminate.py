"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the benchmark items. A document's words are
streamed through it; the state and the matched length after each word are the longest
run, ending there, that occurs in some item. A matched length of ``window`` or more
marks the last ``window`` words as hit; an item of fewer words is hit where all of it occurs.

Defined results: a null or empty text has no words and no hits. A null or empty item has
no window. Items that share an id count once; a null id counts as the empty string. Rows
of documents are never joined or grouped, so repeated rows and null ids give one result each.
An empty benchmark gives no hits. Other columns of the inputs are not read.

Scale: one pass over the documents without a shuffle. The benchmark is cut into blocks of
at most ``BLOCK_WORDS`` words, so that what is broadcast and what a worker builds is
bounded; a larger benchmark takes one more staged pass per block. Items longer than a block
are cut into pieces that overlap by ``window - 1`` words, so that no window is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import encoded, over_batches, table

WINDOW = 10
BLOCK_WORDS = 200_000
# A document with a larger share of hit words is dropped whole.
MAX_COVERAGE = 0.5

# Lower-cases A-Z; what is no digit, letter or byte of a longer character becomes a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Item = tuple[str, list[bytes]]
Span = tuple[int, int]


def words_of(text: str | None) -> list[bytes]:
    return encoded(text).translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over item words, with the items of every window."""

    def __init__(self, items: list[Item], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
            ends.append(state)
        self._mark(items, ends)

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the runs of ``q`` that end in p's longest run and ``word``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return self._split(last, word, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, self.next[p][word])
        return state

    def _mark(self, items: list[Item], ends: list[int]) -> None:
        """Per state: the suffix state of one window's length, and the nearest short item."""
        states = len(self.length)
        self.at_window, self.short_above = [0] * states, [0] * states
        self.items_at: dict[int, set[str]] = {}
        self.short_at: dict[int, tuple[int, set[str]]] = {}
        for (name, words), end in zip(items, ends):
            if 0 < len(words) < self.window:
                # the end state of a short item holds the item, maybe not as its longest run
                self.short_at.setdefault(end, (len(words), set()))[1].add(name)
        for state in sorted(range(1, states), key=self.length.__getitem__):
            link = self.link[state]
            self.at_window[state] = state if self.length[link] < self.window else self.at_window[link]
            self.short_above[state] = state if state in self.short_at else self.short_above[link]
        for name, words in items:
            if len(words) >= self.window:
                for _, state, length in self.stream(words):
                    if length >= self.window:
                        self.items_at.setdefault(self.at_window[state], set()).add(name)

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matched length) for each word that ends a match."""
        edges, link, length = self.next, self.link, self.length
        state = matched = 0
        for place, word in enumerate(words):
            to = edges[state].get(word)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = edges[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            yield place, state, matched

    def match(self, words: list[bytes]) -> tuple[list[Span], set[str], int]:
        """Hit spans of word places, the items with occurring windows, the longest match."""
        window, shorts = self.window, self.short_above
        spans: list[Span] = []
        found: set[str] = set()
        longest = 0
        for place, state, matched in self.stream(words):
            if matched > longest:
                longest = matched
            hit = 0
            if matched >= window:
                hit = window
                found |= self.items_at[self.at_window[state]]
            above = shorts[state]
            while above:
                size, names = self.short_at[above]
                if size <= matched:
                    hit = max(hit, size)
                    found |= names
                above = shorts[self.link[above]]
            if hit:
                add_span(spans, place + 1 - hit, place + 1)
        return spans, found, longest


def add_span(spans: list[Span], start: int, end: int) -> None:
    """Add a span that ends behind all others, joined with those it touches."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def merged(one: list[Span], two: list[Span]) -> list[Span]:
    spans: list[Span] = []
    for start, end in sorted([*one, *two], key=lambda s: s[1]):
        add_span(spans, start, end)
    return spans


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[Item]]:
    """Blocks of items; only one block and one partition of the table is in memory at a time."""
    if block_words < 2 * window:
        raise ValueError("a block must hold two windows")
    block: list[Item] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("id"), "text").toLocalIterator():
        words = words_of(row["text"])
        at = 0
        while at < len(words):
            piece = words[at : at + block_words]
            if held and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((row["id"] or "", piece))
            held += len(piece)
            if at + len(piece) >= len(words):
                break
            at += len(piece) - (window - 1)
    if block:
        yield block


_built: dict[str, Automaton] = {}


def _automaton(name: str, items, window: int) -> Automaton:
    """Built once per worker; the one of another block is let go."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(items.value, window)
    return _built[name]


def _or_empty(blocks: Iterator[list[Item]]) -> Iterator[list[Item]]:
    """The blocks, or one empty block."""
    yield next(blocks, [])
    yield from blocks


_MATCH = "struct<words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>,longest:bigint>"
_CUTS = "struct<words:bigint,hit:bigint,cuts:bigint>"


def _find(automaton: Automaton, text: str | None, old: dict | None) -> tuple[str | None, dict]:
    words = words_of(text)
    spans, found, longest = automaton.match(words)
    if old:
        spans = merged(spans, [(s["start"], s["end"]) for s in old["spans"]])
        found, longest = found | set(old["items"]), max(longest, old["longest"])
    spans_out = [{"start": s, "end": e} for s, e in spans]
    return text, {"words": len(words), "spans": spans_out, "items": sorted(found), "longest": longest}


def cut_spans(text: str, spans: list[Span]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return "".join(out)


def _cut(automaton: Automaton, text: str | None, old: dict | None) -> tuple[str | None, dict]:
    words = words_of(text)
    new = {"words": len(words), "hit": 0, "cuts": 0} | (old or {})
    while spans := automaton.match(words)[0]:
        text = cut_spans(text, spans)
        new["hit"] += sum(end - start for start, end in spans)
        new["cuts"] += 1
        words = words_of(text)
    return text, new


def _sweep(df: DataFrame, benchmark: DataFrame, window: int, block_words: int, step):
    """Run ``step`` on ``__text`` and ``__m`` of every row, one pass per block; also the number of blocks."""
    context, names = df.sparkSession.sparkContext, df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at_text, at_m = names.index("__text"), names.index("__m")
    blocks, count = _or_empty(item_blocks(benchmark, window, block_words)), 0
    for block in blocks:
        if count:
            df = stage(df, "matches")
        items = context.broadcast(block)
        name = f"{context.applicationId}-{items._jbroadcast.id()}-{window}"

        def work(batch, items=items, name=name):
            automaton = _automaton(name, items, window)
            columns = list(batch.columns)
            pairs = zip(columns[at_text].to_pylist(), columns[at_m].to_pylist())
            done = [step(automaton, text, old) for text, old in pairs]
            columns[at_text], columns[at_m] = [d[0] for d in done], [d[1] for d in done]
            return columns

        df, count = over_batches(df, work, schema), count + 1
    return df, count


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, words, spans, items, longest) per row of ``docs``.

    spans are word places (end exclusive), items those with occurring windows, longest the
    longest matched run of words.
    """
    rows = docs.select("doc_id", docs["text"].alias("__text"), F.lit(None).cast(_MATCH).alias("__m"))
    found, _ = _sweep(rows, benchmark, window, block_words, _find)
    return found.select("doc_id", "__m.*")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without hit spans; documents with a larger share of hit words go whole.

    Cutting can bring words together that form a window again, so cut texts are searched
    until nothing is found. All columns stay; ``n_chars`` is counted anew where a text was cut.
    """
    df = docs.withColumns({"__text": docs["text"], "__m": F.lit(None).cast(_CUTS)})
    cuts = 0
    while True:
        df, count = _sweep(df, benchmark, window, block_words, _cut)
        if count == 1:
            break
        df = stage(df, "cuts")
        before, cuts = cuts, df.agg(F.sum("__m.cuts")).first()[0] or 0
        if cuts == before:
            break
    was_cut = F.col("__m.cuts") > 0
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        length = F.length("__text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(was_cut, length).otherwise(F.col("n_chars"))
    kept = df.filter(F.col("__m.hit") <= max_coverage * F.col("__m.words"))
    return kept.withColumns(new).select(*docs.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size
), hits AS (
  SELECT p.doc_id, p.i, p.size, v.item_id
  FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM places) p
  JOIN item_windows v ON v.size = p.size AND v.win = p.win
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
