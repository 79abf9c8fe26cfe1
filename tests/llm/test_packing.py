from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowgate.llm.packing import Bins, measured, op7_packing, pack, pack_documents, token_counts

SF_DIR = "/root/testdata/sf0.01"


def plain_best_fit(rows, capacity, per_source):
    """The rests by looking at every bin for each piece: {row: bin contents in order}."""
    bins, out = [], {}
    rests = []
    for at, (_, tokens, _, _) in enumerate(rows):
        if tokens % capacity or not tokens:
            rests.append((at, tokens % capacity))
    rests.sort(key=lambda r: (-r[1], *[(v is None, v if v is not None else 0) for v in (rows[r[0]][0], rows[r[0]][3], rows[r[0]][2])]))
    for at, size in rests:
        _, _, source, cluster = rows[at]
        best = None
        for number, held in enumerate(bins):
            room = capacity - sum(s for _, s in held)
            if room < size:
                continue
            if cluster is not None and any(rows[o][3] == cluster for o, _ in held):
                continue
            if source is not None and sum(rows[o][2] == source for o, _ in held) >= per_source:
                continue
            if best is None or room < best[0]:
                best = room, number
        if best is None:
            bins.append([])
            best = capacity, len(bins) - 1
        bins[best[1]].append((at, size))
        out[at] = best[1]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_equals_plain_search(seed):
    rng = random.Random(seed)
    sources = ["a", "a", "a", "b", "c", None]
    rows = [(i, rng.choice([0, 1, 3, 5, 7, 10, 19, 20, 25]), rng.choice(sources), rng.choice([None, *range(30)])) for i in range(150)]
    pieces = pack(rows, 10, 2)
    rests = {p[0]: p[3] for p in pieces if p[2] < 10}
    assert rests == plain_best_fit(rows, 10, 2)
    for at, (_, tokens, _, _) in enumerate(rows):
        own = sorted(p[1:3] for p in pieces if p[0] == at)
        assert sum(size for _, size in own) == tokens and len(own) == max(1, -(-tokens // 10))
        assert all(start == 10 * k for k, (start, _) in enumerate(own))


def test_search_goes_on_past_conflicts():
    bins = Bins(10, 1)
    assert [bins.put(6, 0, 0), bins.put(5, 1, 1), bins.put(4, 0, 2), bins.put(4, 2, 1), bins.put(4, 3, 3)] == [0, 1, 1, 0, 2]


def check_bins(pieces, docs, capacity, per_source):
    """No piece is lost, no bin too full, no conflict."""
    bins, own = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p.bin_id].append(p)
        own[p.doc_id].append((p.start, p.length))
    for held in bins.values():
        assert sum(p.length for p in held) <= capacity
        for names in (Counter(docs[p.doc_id][1] for p in held), ):
            assert max(names.values()) <= per_source
        assert max(Counter(docs[p.doc_id][2] for p in held).values()) == 1
    assert set(own) == set(docs)
    for doc_id, parts in own.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == docs[doc_id][0]
    return bins


def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {}
    for r in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        size = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        docs[r.doc_id] = size, r.source, " ".join(words).lower() if size else r.doc_id
    bins = check_bins(op7_packing(spark, SF_DIR).collect(), docs, 2048, 2)
    tokens = sum(d[0] for d in docs.values())
    assert tokens / (2048 * len(bins)) > 0.9


def test_shards_and_blocks(spark):
    rows = [(i, i % 23, "hot" if i % 3 == 0 else f"s{i % 7}", i % 90) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, source string, cluster bigint")
    pieces = pack_documents(df, capacity=20, per_source=1, shard_rows=100, block_rows=30)
    again = pack_documents(df.repartition(7), capacity=20, per_source=1, shard_rows=100, block_rows=30)
    found = sorted(map(tuple, pieces.collect()))
    assert found == sorted(map(tuple, again.collect()))
    named = pieces.selectExpr("concat_ws('-', shard, block, bin) AS bin_id", "doc_id", "start", "length").collect()
    check_bins(named, {i: (n, s, c) for i, n, s, c in rows}, 20, 1)


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", None, 2), (2, "A b", "s", 3), (2, "A b", "s", 4), (3, " a  B\n", "s", 5), (4, "w " * 5000, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, bin bigint")
    pieces = pack_documents(measured(docs), per_source=9).collect()
    lengths = Counter((p.doc_id, p.start, p.length) for p in pieces)
    assert lengths == Counter([(None, 0, 0), (1, 0, 0), (2, 0, 2), (2, 0, 2), (3, 0, 2), (4, 0, 2048), (4, 2048, 2048), (4, 4096, 904)])
    same = [(p.shard, p.block, p.bin) for p in pieces if p.doc_id in (2, 3)]
    assert len(set(same)) == 3
    assert pack_documents(measured(docs.limit(0))).count() == 0


def test_pieces_are_tokens(spark):
    """Pieces and bins in tokens of the vocabulary, by the library; also in the pipeline, and a long text without blanks."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, "An unquestionably hyphen-ated sentence, twice. " * 300, "a"), (2, "qzxj" * 4000, None), (3, None, "a"), (4, "", "b"), (None, "Straße 12 été", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in measured(docs, path).collect()} == sizes and sizes[2] > 2048
    found, bins = defaultdict(list), Counter()
    for p in corpus_pipeline.packed(spark, docs, "").collect():
        found[p.doc_id].append((p.start, p.length))
        bins[p.bin_id] += p.length
    assert {i: sum(n for _, n in of) for i, of in found.items()} == sizes and max(bins.values()) <= 2048
    assert all(start == 2048 * k for of in found.values() for k, (start, _) in enumerate(sorted(of)))


def test_counts_are_the_library_s():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [None, "", " ", "  a \n b\t", "It's 12,000 'quoted' words...\n\nÉté\u00a0x", "z" * 500, "<|endoftext|> a", "日本 語 \u2003x"]
    expected = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts(texts, path) == expected == token_counts(texts, path)


def test_equal_rows_are_dealt_over_shards(spark):
    """20,000 equal rows, and as many empty ones, are many shards and few bins."""
    df = spark.range(20_000).selectExpr("7L AS doc_id", "500 AS n_tokens", "'s' AS source", "1L AS cluster")
    df = df.unionByName(spark.range(20_000).selectExpr("CAST(NULL AS BIGINT)", "0", "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)").toDF(*df.columns))
    pieces = pack_documents(df, shard_rows=1000)
    sizes = {r["shard"]: r["count"] for r in pieces.groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 40_000 and max(sizes.values()) < 8_000 and len(sizes) > 15
    equal = pieces.where("doc_id = 7").groupBy("shard", "block", "bin").count()
    assert equal.count() == 20_000  # copies share no bin
    assert pieces.where("doc_id IS NULL").select("shard", "block", "bin").distinct().count() < 100


def test_near_copies_share_no_bin(spark):
    words = [f"w{i * i % 997}x{i}" for i in range(900)]
    texts = [" ".join([*words[:at], "changed", *words[at + 1 :]]) for at in (100, 500, 800)] + ["something else " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "CAST(NULL AS STRING) AS source")
    clusters = {r.doc_id: r.cluster for r in measured(docs).collect()}
    assert clusters[0] == clusters[1] == clusters[2] != clusters[3]
    bins = {p.doc_id: (p.shard, p.block, p.bin) for p in pack_documents(measured(docs)).collect()}
    assert len({bins[0], bins[1], bins[2]}) == 3
