from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rowgate.llm.components import components
from rowgate.llm.simhash import fingerprint, keep_one, links, near_duplicates, op5_simhash, shingle_hashes

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """node -> smallest node, by walking from each."""
    todo, out = sorted(nodes), {}
    for start in todo:
        if start in out:
            continue
        stack = [start]
        while stack:
            node = stack.pop()
            if node not in out:
                out[node] = start
                stack += [n for n in linked(node) if n not in out]
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b C", "a b c d", "A  b\tc\nd e", "é ß 漢字 x y z", "x " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_shingles_of_every_size():
    words = ["a", "Été", "x" * 3000, "a", "a", "ß.", "b"]
    for size in range(1, 9):
        runs = [words[k : k + size] for k in range(max(1, len(words) - size + 1))]
        expected = [xxhash.xxh64_intdigest(" ".join(r).replace("É", "\0").lower().replace("\0", "É").encode(), 42) for r in runs]
        found = shingle_hashes(" \t" + "  ".join(words) + "\n", size)
        assert found.dtype == "uint64" and found.tolist() == expected
    assert shingle_hashes(" \n").tolist() == shingle_hashes(None).tolist() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    near = plain_components(fps, lambda i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4])
    expected = sorted((i, f"{fps[i]:016x}", near[i]) for i in fps)
    assert sorted(map(tuple, op5_simhash(spark, SF_DIR).collect())) == expected


@pytest.mark.parametrize("bucket", [2, 7, 1024])
def test_links_connect_what_is_near(spark, bucket):
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:6]:
        for _ in range(40):
            flips = rng.sample(range(64), rng.randint(1, 6))
            fps.add(centre ^ sum(1 << b for b in flips))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bucket=bucket).collect()
    as_bits = lambda x: x & (1 << 64) - 1
    assert all(0 < (as_bits(r.u) ^ as_bits(r.v)).bit_count() <= 4 for r in found)
    near = {f: set() for f in signed}
    for r in found:
        near[r.u].add(r.v)
        near[r.v].add(r.u)
    of_links = plain_components(signed, near.__getitem__)
    of_all = plain_components(signed, lambda f: [g for g in signed if (as_bits(f) ^ as_bits(g)).bit_count() <= 4])
    assert of_links == of_all


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (5, 1000), (1000, 5)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    roots = dict(map(tuple, components(df).collect()))
    assert roots == {i: 100 for i in range(101, 401)} | {i: 5 for i in range(1000, 1200)}
    assert components(df.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "y"), (None, " ", "z"), (8, "a b c d e", "s"), (8, "a b c d e", "s"), (9, "A B c d e", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    found = Counter(map(tuple, near_duplicates(docs).select("doc_id", "component_id").collect()))
    assert found == Counter([(3, 1), (1, 1), (None, 1), (8, 8), (8, 8), (9, 8)])
    assert sorted((tuple(r) for r in keep_one(docs).collect()), key=repr) == sorted(
        [(1, "", "y"), (8, "a b c d e", "s"), (None, " ", "z")], key=repr
    )
    assert near_duplicates(docs.limit(0)).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert {r.component_id for r in near_duplicates(nameless).collect()} == {None}
