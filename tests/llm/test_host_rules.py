from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgate.llm.host_rules import OP9_SQL, host_verdicts, judge, measure, op9_host_rules

SF_DIR = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b c d e a b c d e", "x x x x x x x", "l\nl\n\nm\n l", "é漢🙂 #*$ | <>&%", "a b c d e f a b c d e", "w " * 100_000, "\x0ba\x0cb\x1cc d e"]


def test_measures(spark):
    words = st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "#"]), max_size=40)
    made = []
    settings(max_examples=150, deadline=None)(given(words)(lambda w: made.append(" ".join(w))))()
    texts = [*TEXTS, *made]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'h' AS source", "1 AS words")
    rows = measure(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]), texts[r.doc_id]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in op9_host_rules(spark, SF_DIR).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_no_python_in_the_plan(spark):
    plan = op9_host_rules(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_host_verdicts(spark):
    """A bad host goes; one with few rows is drawn to the others."""
    rows = [("good", False)] * 500 + [("bad", True)] * 60 + [("bad", False)] * 5 + [("tiny", True)] + [(None, False)] * 90
    rows += [(f"h{k}", i == 0) for k in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, symbols boolean").selectExpr("*", "false few_words", "false repeats", "false lines")
    assert {r.host for r in host_verdicts(df).collect() if r.rejected} == {"bad"}
    assert host_verdicts(df.filter("host = 'good'")).collect()[0].rejected is False


def test_verdicts_take_effect(spark):
    fine = " ".join(f"w{i}" for i in range(30))
    marked = fine + " # # # # #"
    rows = [(i, marked if i % 4 else fine, "bad") for i in range(80)] + [(100 + i, marked if i == 0 else fine, f"h{i % 9}") for i in range(90)]
    rows += [(500, None, None), (501, fine, None), (502, "few words", "h1"), (502, "few words", "h1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = Counter(r.doc_id for r in judge(df).collect() if r.kept)
    expected = [i for i in range(80) if i % 4 == 0] + list(range(100, 190)) + [501]
    assert kept == Counter(expected)
    assert judge(df).count() == len(rows)
    assert judge(df.limit(0)).count() == 0


def test_a_worse_host_goes(spark):
    """40 per cent against 5 for the rest; below the least number of documents, or the least rate, a host stays."""
    rates = {"worse": (200, 80), "few": (15, 9), "mild": (300, 45), **{f"h{k}": (300, 15) for k in range(10)}}
    rows = [(h, i < bad) for h, (n, bad) in rates.items() for i in range(n)]
    df = spark.createDataFrame(rows, "host string, repeats boolean").selectExpr("*", "false few_words", "false symbols", "false lines")
    assert {r.host for r in host_verdicts(df).collect() if r.rejected} == {"worse"}


def test_rejected_hosts_by_sql(spark, tmp_path):
    """Where a host is rejected, the query still gives the rows of its SQL."""
    fine = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{fine} # # # # # {i}" if i % 10 < 4 else f"{fine} {i}", "worse") for i in range(100)]
    rows += [(1000 + i, f"{fine} # # # # # {i}" if i % 20 == 0 else f"{fine} {i}", f"h{i % 5}") for i in range(900)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op9_host_rules(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(found, connection, OP9_SQL) is None
    gone = {r.doc_id for r in found.collect() if not r.kept}
    assert gone == {i for i in range(100) if i % 10 < 4}
