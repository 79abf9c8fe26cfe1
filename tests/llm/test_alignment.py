from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rowgate.llm import alignment
from rowgate.llm.alignment import Aligner, Csr, align_texts, byte_level_characters, op11_alignment, row_products, score_links
from rowgate.session import stage

SF_DIR = "/root/testdata/sf0.01"
PATHS = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ONE, TWO = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
ONE.encode_special_tokens = True
ALIGNER = Aligner(*PATHS)


BYTE = byte_level_characters()


def token_bytes(side: int, token: int) -> bytes:
    if side == 0:
        return bytes(map(BYTE.__getitem__, ONE.id_to_token(token)))
    piece = TWO.id_to_piece(token)
    return bytes([int(piece[3:5], 16)]) if TWO.is_byte(token) else piece.replace("▁", " ").encode()


def groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of a text by walking along both tokenizations of the whole text."""
    if not text:
        return []
    sides = ONE.encode(" " + text, add_special_tokens=False).ids, TWO.encode(text)
    if any(b"".join(token_bytes(k, i) for i in ids) != (" " + text).encode() for k, ids in enumerate(sides)):
        return []
    found, group, ends, at = [], ([], []), [0, 0], [0, 0]
    while at[0] < len(sides[0]) or at[1] < len(sides[1]):
        side = 0 if ends[0] <= ends[1] else 1
        token = sides[side][at[side]]
        group[side].append(token)
        at[side] += 1
        ends[side] += len(token_bytes(side, token))
        if ends[0] == ends[1]:
            found.append(group)
            group = ([], [])
    return found


def shown(found: list) -> str:
    return ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in found)


pieces = st.one_of(
    st.sampled_from(["the", " ", "  ", "\n", "hello world", "l'été", "中文", "😀", "<s>", "<|endoftext|>", "\x00", "<0x41>", "Ünï", "===="]),
    st.characters(codec="utf-8", exclude_characters="▁"),
)


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=20).map("".join))
def test_groups_and_links(text):
    found, expected = ALIGNER.align(text), groups(text)
    assert ALIGNER.groups_text(found) == shown(expected)
    links = Counter((a << 32) + b for one, two in expected for a in one for b in two)
    assert dict(zip(found["pairs"].tolist(), found["times"].tolist())) == links
    assert (found["n_groups"], found["n_links"]) == (len(expected), links.total())


def test_overlaps():
    found = ALIGNER.align("unbelievable résumés of 漢字")
    ends = [np.cumsum([0, *(len(token_bytes(s, i)) for i in found[k].tolist())]) for s, k in enumerate("ab")]
    shared = {
        (i, j): int(min(ends[0][i + 1], ends[1][j + 1]) - max(ends[0][i], ends[1][j]))
        for i in range(len(found["a"]))
        for j in range(len(found["b"]))
    }
    rows, columns, values = found["overlaps"]
    assert dict(zip(zip(rows.tolist(), columns.tolist()), values.tolist())) == {k: v for k, v in shared.items() if v > 0}


@pytest.mark.parametrize("products", [1, 7, 1000])
def test_row_products(monkeypatch, products):
    """Against dense matrices, in blocks of any size, with empty rows."""
    monkeypatch.setattr(alignment, "PRODUCTS", products)
    rng = np.random.default_rng(products)
    for rows, inner, columns in [(1, 1, 1), (5, 7, 3), (20, 9, 30), (3, 4, 0)]:
        left, right = rng.random((rows, inner)) < 0.4, rng.random((inner, columns)) < 0.4
        sparse = [Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1]) for m in (left, right)]
        dense = np.zeros((rows, columns), int)
        for r, c, v in row_products(*sparse):
            dense[r, c] += v
        assert (dense == left.astype(int) @ right.astype(int)).all()


def expected_rows(texts: list) -> list[tuple]:
    all_groups = [groups(t) for t in texts]
    links = [Counter((a, b) for one, two in found for a in one for b in two) for found in all_groups]
    counts = Counter(pair for found in links for pair in found)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (
            sum(len(g[0]) for g in found),
            sum(len(g[1]) for g in found),
            len(found),
            link.total(),
            sum(t for p, t in link.items() if counts[p] == most[p[0]]),
            sum(t * counts[p] for p, t in link.items()),
            hashlib.sha256(shown(found).encode()).hexdigest() if found else "",
        )
        for found, link in zip(all_groups, links)
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("length(text) < 1500")
    odd = [(-1, None), (-2, ""), (-3, "an underline ▁ mark"), (None, "null id"), (-4, "twice"), (-4, "twice"), (-5, "lo ng " * 20_000)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    docs.selectExpr("*", "1 AS n_a", "2 AS links", "'x' AS row", "3 AS pair").write.parquet(f"{tmp_path}/documents.parquet")
    given_rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    expected = expected_rows([t for _, t in given_rows])
    found = op11_alignment(spark, str(tmp_path)).collect()
    rows = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in found), key=repr)
    assert rows == sorted(((i, *e) for (i, _), e in zip(given_rows, expected)), key=repr)


def test_rare_pairs_are_joined(spark):
    """Whatever share of the pairs is broadcast, the sums are the same."""
    texts = ["one two three", "two three four", "three four five", "", "three"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = stage(align_texts(docs, *PATHS, ("links",)).withColumnRenamed("doc_id", "row"), "links")
    expected = {i: e[4:6] for i, e in enumerate(expected_rows(texts)) if e[3]}
    for entries in (0, 3, 1 << 18):
        assert {r.row: (r.n_best, r.count_sum) for r in score_links(rows, entries=entries).collect()} == expected


def test_all_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in align_texts(docs, *PATHS).collect()}
    assert rows[1].a_groups == sorted(rows[1].a_groups) and len(rows[1].a_ids) == rows[1].n_a == len(rows[1].a_groups)
    assert sum(o["bytes"] for o in rows[1].overlaps) == len(" ab cd")
    assert (rows[2].n_a, rows[2].groups, rows[2].links, rows[2].overlaps) == (0, "", [], [])
    assert align_texts(docs.limit(0), *PATHS).count() == 0
