from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgate.llm.decontaminate import Automaton, cut_spans, decontaminate, find_matches, words_of


def plain(words, items, window):
    """Hit places, items and the longest match, by trying everything."""
    hit, found, longest = set(), set(), 0
    for name, item in items:
        size = min(window, len(item))
        for a in range(len(words)):
            for b in range(len(item)):
                n = 0
                while a + n < len(words) and b + n < len(item) and words[a + n] == item[b + n]:
                    n += 1
                longest = max(longest, n)
                if size and n >= size and b + size <= len(item):
                    hit.update(range(a, a + size))
                    found.add(name)
    return hit, found, longest


letters = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(letters, st.lists(letters, max_size=5), st.integers(1, 5))
def test_automaton_equals_trying_everything(words, items, window):
    named = [(str(k), w) for k, w in enumerate(items)]
    spans, found, longest = Automaton(named, window).match(words)
    hit, expected, most = plain(words, named, window)
    assert {p for a, b in spans for p in range(a, b)} == hit
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert (found, longest) == (expected, most)


def test_words():
    assert words_of("It's É-ß, 9\x7fa\x00b\x85c") == [b"it", b"s", "É".encode(), "ß".encode(), b"9", b"a", "b\x85c".encode()]
    assert words_of(None) == words_of("") == words_of(" ,.") == []
    assert cut_spans("One two-three, FOUR five.", [(1, 3)]) == "One , FOUR five."


@pytest.fixture
def tables(spark):
    source = random.Random(3)
    word = lambda: source.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(source.randint(0, 40)))) for k in range(12)] + [(None, "x y"), (3, None), (50, "q r s")]
    texts = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(20))]
        if k % 3 == 0:
            words = items[source.randrange(12)][1].split()
            parts.append(" ".join(words[2:14]))
        texts.append((k, "; ".join([*parts, " ".join(word() for _ in range(20))]).upper() if k % 2 else ". ".join(parts), "z"))
    texts += [(None, "x y", "z"), (1000, None, None), (1001, "", "z"), (0, texts[0][1], "z"), (1002, "w " * 100_000 + "q r s", "z")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, items string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), texts, items


@pytest.mark.parametrize("block", [20, 60, 200_000])
def test_matches_do_not_depend_on_blocks(tables, block):
    docs, benchmark, texts, items = tables
    named = [("" if k is None else str(k), words_of(t)) for k, t in items]
    expected = []
    for doc_id, text, _ in texts:
        words = words_of(text)
        if doc_id == 1002:
            expected.append((doc_id, 100_003, 3, ("50",)))
            continue
        hit, found, _ = plain(words, named, 10)
        expected.append((doc_id, len(words), len(hit), tuple(sorted(found))))
    rows = find_matches(docs, benchmark, block_words=block).collect()
    found = [(r.doc_id, r.words, sum(s.end - s.start for s in r.spans), tuple(r.items)) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("block", [20, 200_000])
def test_decontaminate(tables, block):
    docs, benchmark, texts, _ = tables
    out = decontaminate(docs, benchmark, max_coverage=0.5, block_words=block)
    assert out.schema == docs.schema
    assert find_matches(out, benchmark).filter("size(spans) > 0").count() == 0
    before = {r.doc_id: r for r in find_matches(docs, benchmark).collect()}
    rows = {r.doc_id: r for r in out.collect()}
    for doc_id, text, _ in texts:
        if not before[doc_id].spans:
            assert rows[doc_id].text == text
        elif doc_id in rows:
            assert rows[doc_id].n_chars == len(rows[doc_id].text) < len(text)
    assert None not in rows and 1002 in rows and rows[1002].text.rstrip() == ("w " * 100_000).rstrip()
    assert out.count() >= len(texts) - 25


def test_empty_tables(tables):
    docs, benchmark, _, _ = tables
    assert find_matches(docs.limit(0), benchmark).count() == 0
    assert find_matches(docs, benchmark.limit(0)).filter("size(spans) > 0 OR longest > 0").count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == docs.count()
