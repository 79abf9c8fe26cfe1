from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgate.llm.pii import KINDS, Crf, base_spans, candidates, edges, find_entities, fit, luhn, op2_pii, redact

SF_DIR = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def holds(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(k, *m.span()) for m in re.finditer(pattern, text or "") if holds(kind, m.group())]
    return sorted(out, key=lambda s: (s[1], s[0]))


pieces = st.sampled_from(
    ["a", "b.", "@", "x@y.z", ".", "-", " ", "1", "25", "300", "255.1.2.3", "4111 1111 1111 1111", "+1 (555) 010-9999", "+", "(", "\n", "é", "漢", "79927398713"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans(text):
    assert base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", [None, "", "9" * 50_000, "a" * 100_000 + "@", "1." * 30_000, "+1" * 20_000, "+1" + "(" * 30_000, "x@" * 20_000])
def test_hard_texts_end_soon(text):
    assert base_spans(text) == [] or text.startswith("1.")
    assert len(Crf().added(text, base_spans(text))) == 0


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_equal_tokens_are_linked_in_a_row():
    text = " ".join(["5550100", "x"] * 500)
    links = edges(candidates(text, []))
    assert len(links) == 499 and all(s == 1 and j == i + 1 for i, j, s in links)


def exact_marginals(crf, tokens):
    """By summing over all labellings of a small document."""
    import itertools

    import numpy as np

    from rowgate.llm.pii import LABELS, shape

    total = np.zeros((len(tokens), LABELS))
    for labels in itertools.product(range(LABELS), repeat=len(tokens)):
        if any(t.label and t.label != x for t, x in zip(tokens, labels)):
            continue
        score = sum(crf.unary.get(shape(t.text), crf.unseen)[x] for t, x in zip(tokens, labels) if not t.label)
        score += sum(crf.pair[s][labels[i]][labels[j]] for i, j, s in edges(tokens))
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_are_exact_on_trees():
    import numpy as np

    rng = np.random.default_rng(1)
    tokens = candidates("call 5550100 then 5550100 and 12 34 q1", [(3, 5, 12)])
    pair = rng.normal(size=(2, 5, 5))
    crf = Crf({}, rng.normal(size=5).tolist(), (pair + pair.transpose(0, 2, 1)).tolist())
    assert np.allclose(crf.marginals(tokens), exact_marginals(crf, tokens), atol=5e-3)


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, f"text {i % 7} to +1 (555) 010-{1000 + i} or {i}.77@mail.org end 3 of {i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return fit(docs)


def test_repeats_in_another_form_are_added(learned):
    text = "dial +1 (555) 010-2345 today. Later (555) 010-2345 again, 17 of 20"
    base = base_spans(text)
    assert [KINDS[s[0]] for s in base] == ["phone"]
    added = learned.added(text, base)
    assert [(KINDS[k], text[a:b]) for k, a, b in added] == [("phone", "(555) 010-2345")]
    assert learned.added("page 12 of 2024, room b7, 3.5 or 17%", []) == []


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op2_pii(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_redact_and_odd_rows(spark, learned):
    rows = [(1, "mail a@b.c or 10.0.0.1!", "x", 3), (None, None, "y", None), (2, "", None, 0), (2, "", None, 0), (3, "plain", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, added string, n_chars bigint")
    out = sorted((tuple(r) for r in redact(docs, learned).collect()), key=repr)
    assert out == sorted([(1, "mail [EMAIL] or [IP]!", "x", 21), *rows[1:]], key=repr)
    assert redact(docs.limit(0), learned).columns == docs.columns
    found = find_entities(docs, fit(docs.limit(0)))
    assert sorted(len(r.base) for r in found.collect()) == [0, 0, 0, 0, 2]
    assert found.filter(F.size("added") > 0).count() == 0
