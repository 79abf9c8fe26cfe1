from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from rowgate.llm import collocations as module
from rowgate.llm.collocations import Filter, collocations, frequent_filter, op13_collocations, words_of


def brute(rows, least, longest=5, top=2000, cover=100):
    """Every phrase of every text, one after another."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: n for p, n in found.items() if len(p) > 1 and n >= least}
        kept = []
        for phrase, a in frequent.items():
            inside = f" {' '.join(phrase)} "
            if any(len(o) > len(phrase) and 100 * b >= cover * a and inside in f" {' '.join(o)} " for o, b in frequent.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (found[phrase[:k]] * found[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), found[phrase[:k]], found[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def random_rows(seed, rows, words="a b c d é A".split()):
    rng = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
    return [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(rows)]


@pytest.mark.parametrize(("seed", "least", "cover"), [(1, 5, 100), (2, 3, 100), (3, 8, 60), (4, 2, 100)])
def test_against_every_phrase(spark, monkeypatch, seed, least, cover):
    monkeypatch.setattr(module, "CHUNK_WORDS", 300)  # many stripes of each prefix to merge
    rows = random_rows(seed, 300)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, doc_id bigint").repartition(5)
    assert found(collocations(docs, least, cover=cover)) == brute(rows, least, cover=cover)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that lets everything pass, as it would on a huge corpus, only costs time."""
    rows = random_rows(7, 200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(module, "frequent_filter", lambda phrases: Filter(np.full(16, 2**64 - 1, np.uint64)))
    assert found(collocations(docs, 4)) == brute(rows, 4)


def test_filter_denies_no_phrase(spark):
    phrases = [("en", f"w{i} é{i % 7}") for i in range(3000)]
    table = spark.createDataFrame(phrases, "lang string, phrase string")
    made = frequent_filter(table)
    ids, words = np.arange(1, 2 * 3000 + 1), [b"\xff", *(w.encode() for _, p in phrases for w in p.split())]
    assert module._passing(ids, words, 2, "en", made)[:-1:2].all()
    assert module._passing(ids, words, 2, "de", made).mean() < 0.05
    assert len(frequent_filter(table, 1 << 10).cells) * 64 == 1 << 10


def test_words():
    assert words_of("Ab\tÉc.d  e\r\n\x0cf") == [b"ab", "Éc".encode(), b"\xff", b"d", b"e", b"\xff", b"\xff", b"\xff", b"f", b"\xff"]
    assert set(words_of(" . ")) == {b"\xff"} and words_of(None) == [b"\xff"]


def test_odd_rows(spark, tmp_path):
    rows = [("en", None), ("en", ""), (None, "new york " * 60_000), ("und", "New York " * 150), ("en", "x" * 300_000)]
    rows += [("en", "same line here")] * 120
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'p' AS phrase", "0 AS slot", "2 AS next")
    assert found(collocations(docs)) == brute(rows, 100)
    assert found(collocations(docs.limit(0))) == []
    docs.where("lang = 'en'").write.parquet(f"{tmp_path}/documents.parquet")
    assert found(op13_collocations(spark, str(tmp_path))) == [("en", 1, "same line here", 120, 120, 120, 361, 3008)]


def test_ties_and_hot_prefix(spark):
    """One word before 400 others, each pair as often as the next; equal scores are in order of their bytes."""
    rows = [("en", ". ".join(f"the w{i}" for i in range(400)))] * 100
    best = found(collocations(spark.createDataFrame(rows, "lang string, text string")))
    assert best == brute(rows, 100) and len(best) == 400
