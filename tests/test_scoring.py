from __future__ import annotations

import json
import os
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowgate.functions.json_text import clean_response, json_span
from rowgate.operators import (
    align_verdicts,
    apply_verdicts,
    batch_audit,
    batch_table,
    explode_samples,
    explode_verdicts,
    gate_metrics,
    parse_payload,
    quality_gate,
    require_complete,
    row_batches,
    run_scorer,
    score_requests,
    with_samples,
)
from rowgate.operators.scoring import Journal
from rowgate.plans import Plan

PLAN = Plan(
    "qa", "pairs", {"type": "object", "properties": {"q": {"type": "string", "minLength": 3}}, "required": ["q"]}, batch_size=2
)


def spans(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    return [r[0] for r in df.select(json_span(clean_response(F.col("t")))).collect()]


def test_payload_in_noise(spark):
    assert spans(
        spark,
        '```json\n{"a": 1, "b": [1,2,3]}\n```',
        '<think>internal {reasoning}</think>\n{"ok": true}',
        'Here is data: {"x": {"y": "value with } brace"}} trailing text',
        "no json here",
        '<think>{"open": 1} {"a": 2}',
        "a ```first [1]``` b ```[2]```",
        "[1, 2} [3]",
        '{"a": "unclosed',
        "{'a': 1}",
        '[note] {"a": 1}',
        '{"a": "esc \\" } ", "b": 1.0}]',
        "<THINK>x</Think><think>y</think>[ ]",
        "```[1]",
        "",
    ) == [
        '{"a":1,"b":[1,2,3]}',
        '{"ok":true}',
        '{"x":{"y":"value with } brace"}}',
        None,
        '{"open":1}',
        "[1]",
        None,
        None,
        None,
        None,
        '{"a":"esc \\" } ","b":1.0}',
        "[]",
        "[1]",
        None,
    ]


def test_cleaning_against_brute_force(spark):
    source = random.Random(3)
    tokens = ["<think>", "</think>", "<THINK>", "</Think>", "```", "```JSON", "json", "x", " ", "\n", "{", "}", "\u2003", "é"]
    texts = ["".join(source.choices(tokens, k=source.randrange(14))) for _ in range(3000)]
    expected = []
    for text in texts:
        text = re.sub("<think>.*?</think>", "", text.strip(), flags=re.S | re.I).strip()
        fence = re.search(r"```(?:json)?\s*(.*?)```", text, flags=re.S | re.I)
        expected.append(fence.group(1).strip() if fence else text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(clean_response(F.col("t"))).collect()] == expected


def test_reasons_and_long_text(spark):
    prose, fences = "word { \" " * 20_000, "word ``` { \" " * 20_000
    texts = ["none", "{bad", "[1] " + prose, prose, "[1] " + fences, "<think>" * 20_000, "```" + prose]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    reasons = ["no_payload", "bad_json", None, "bad_json", "bad_json", "no_payload", "bad_json"]
    assert [r.reason for r in parse_payload(df).orderBy("i").collect()] == reasons


def test_samples(spark):
    df = spark.createDataFrame(
        [(0, '[{"a": 1.0}, "x"]'), (1, 'ok: {"samples": [{"a": 2}]}'), (2, '{"rows": []}'), (3, '{"samples": "[1]"}'), (4, "[]")],
        "batch_id int, text string",
    )
    found = explode_samples(df).orderBy("batch_id", "pos").collect()
    assert [(r.batch_id, r.pos, r.raw) for r in found] == [(0, 0, '{"a":1.0}'), (0, 1, '"x"'), (1, 0, '{"a":2}')]
    errors = {r.batch_id: r.error for r in with_samples(df).collect()}
    assert errors == {
        0: None, 1: None, 2: "Expected a list of samples, got dict", 3: "Expected a list of samples, got dict", 4: None,
    }


def test_last_batch_is_short_and_requests_hold_the_rows(spark, json_rows):
    rows = json_rows([f'{{"q": "row {i}", "n": {i}.0}}' for i in range(7)])
    batched = row_batches(rows, 3)
    assert [(r.batch_id, r.pos, r.batch_n) for r in batched.orderBy("seq").collect()] == [
        (0, 0, 3), (0, 1, 3), (0, 2, 3), (1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 0, 1),
    ]
    requests = score_requests(batched, PLAN).orderBy("batch_id").collect()
    assert [r.n_rows for r in requests] == [3, 3, 1]
    assert json.loads(requests[1].message.split("Samples:\n")[1]) == [{"q": f"row {i}", "n": float(i)} for i in (3, 4, 5)]
    assert "qa" in requests[0].instructions


VERDICTS = {
    "good": '[{"index":1,"is_valid":true,"score":0.7},{"index":0,"is_valid":true,"score":0.69,"issues":["weak"]}]',
    "defaults": '[{"is_valid":true},{"is_valid":false}]',
    "short": '[{"index":0,"is_valid":true}]',
    "long": '[{"is_valid":true},{"is_valid":true},{"is_valid":true}]',
    "empty": "[]",
    "range": '[{"index":0,"is_valid":true},{"index":2,"is_valid":true}]',
    "huge": '[{"index":0,"is_valid":true},{"index":99,"is_valid":true}]',
    "negative": '[{"index":0,"is_valid":true},{"index":-1,"is_valid":true}]',
    "repeated": '[{"index":0,"is_valid":true},{"index":0,"is_valid":true}]',
    "null index": '[{"index":null,"is_valid":true},{"index":1,"is_valid":true}]',
    "text index": '[{"index":"0","is_valid":true},{"index":1,"is_valid":true}]',
    "no verdict": '[{"index":0},{"index":1,"is_valid":true}]',
    "text verdict": '[{"index":0,"is_valid":"false"},{"index":1,"is_valid":true}]',
    "text score": '[{"index":0,"is_valid":true,"score":"high"},{"index":1,"is_valid":true}]',
    "bad score of a rejected row": '[{"index":0,"is_valid":false,"score":null},{"index":1,"is_valid":true}]',
    "not objects": "[1, 2]",
    "prose": "I think they are fine",
    "object": '{"index":0,"is_valid":true}',
}
REASONS = {
    "short": "count_mismatch", "long": "count_mismatch", "empty": "count_mismatch", "range": "bad_index",
    "huge": "bad_index", "negative": "bad_index", "repeated": "duplicate_index", "null index": "bad_index",
    "text index": "bad_index", "no verdict": "missing_is_valid", "text verdict": "missing_is_valid",
    "text score": "bad_score", "not objects": "parse_error",
    "prose": "No JSON object/array payload found in response",
    "object": "Expected a list of validation results, got dict", "silent": "no_response",
}


def test_verdicts_fail_closed(spark):
    names = [*VERDICTS, "silent"]
    rows = spark.createDataFrame(
        [(i, p, 2, f"{name}-{p}") for i, name in enumerate(names) for p in range(2)],
        "batch_id bigint, pos int, batch_n int, row string",
    )
    responses = spark.createDataFrame([(names.index(n), t) for n, t in VERDICTS.items()], "batch_id bigint, text string")
    found = apply_verdicts(align_verdicts(rows, explode_verdicts(responses), 4)).collect()
    assert len(found) == 2 * len(names)
    by_row = {r.row: (r.status, r.score, r.issues) for r in found}
    for name, reason in REASONS.items():
        for p in range(2):
            assert by_row[f"{name}-{p}"] == ("rejected", 0.0, [f"validator_error: {reason}"]), name
    assert by_row["good-0"] == ("rejected", 0.69, ["weak"]) and by_row["good-1"] == ("accepted", 0.7, [])
    assert by_row["defaults-0"] == ("accepted", 1.0, []) and by_row["defaults-1"] == ("rejected", 0.0, [])
    assert by_row["bad score of a rejected row-0"] == ("rejected", None, [])
    assert by_row["bad score of a rejected row-1"] == ("accepted", 1.0, [])


def test_very_many_verdicts_for_one_batch(spark):
    rows = spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "batch_id bigint, pos int, batch_n int")
    many = spark.range(200_000).select(
        F.lit(0).cast("bigint").alias("batch_id"), F.col("id").alias("idx"), F.lit(True).alias("is_valid"),
        F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("issues"),
    )
    one = spark.createDataFrame([(1, 0, True, 1.0, [])], many.schema)
    found = align_verdicts(rows, many.unionByName(one), 1).orderBy("batch_id").collect()
    assert [r.batch_error for r in found] == ["count_mismatch", None]


def make_scripted():
    """A scorer factory; nested, so that it travels to the workers by value."""

    def scripted():
        """Answers by the rows in the request: good at once, good after a repair, never, or an error."""

        def answer(messages):
            rows = json.loads(messages[1]["content"].split("Samples:\n")[1])
            word = rows[0]["q"].split()[0]
            if word == "down":
                raise ConnectionError("refused")
            if word == "never" or (word == "later" and len(messages) == 2):
                return "sorry"
            if word == "later":
                assert messages[2] == {"role": "assistant", "content": "sorry"}
                assert "could not be parsed" in messages[3]["content"]
            return "```json\n" + json.dumps([{"index": i, "is_valid": True, "score": 0.9} for i in range(len(rows))]) + "```"

        return answer

    return scripted


def test_scorer_rounds_and_the_whole_gate(spark, json_rows):
    words = ["good a", "good b", "later a", "later b", "never a", "never b", "down a", "down b", "good a", "x"]
    rows = json_rows([json.dumps({"q": w}) for w in words] + ["{"])
    answers = {}

    def verdicts(batched):
        found = run_scorer(score_requests(batched, PLAN), make_scripted())
        answers.update({r.batch_id: (r.attempts, r.error) for r in found.collect()})
        return explode_verdicts(found)

    gated = quality_gate(rows, PLAN, verdicts)
    found = {r.seq: (r.status, r.issues) for r in gated.collect()}
    nothing = "No JSON object/array payload found in response"
    assert answers == {
        0: (1, None), 1: (2, None), 2: (3, nothing), 3: (1, "ConnectionError: refused"), 4: (1, None),
    }
    assert found == {
        0: ("accepted", []), 1: ("accepted", []), 2: ("accepted", []), 3: ("accepted", []),
        4: ("rejected", [f"validator_error: {nothing}"]), 5: ("rejected", [f"validator_error: {nothing}"]),
        6: ("rejected", ["validator_error: ConnectionError: refused"]),
        7: ("rejected", ["validator_error: ConnectionError: refused"]),
        8: ("duplicate", ["duplicate_exact"]), 9: ("rejected", ["$.q: string too short (1 < 3)"]),
        10: ("rejected", ["bad_json"]),
    }
    assert gate_metrics(gated).first().asDict() == {
        "raw_sample_count": 11, "valid_count": 4, "rejected_count": 7, "duplicate_count": 1, "validation_error_batches": 2,
    }


def test_batches_of_a_run(spark):
    totals = spark.createDataFrame([("a", 25), ("b", 1_000_003)], "chunk_id string, total bigint")
    batches = batch_table(totals, 10)
    assert [r.n_rows for r in batches.where("chunk_id = 'a'").orderBy("batch_index").collect()] == [10, 10, 5]
    big = batches.where("chunk_id = 'b'").agg(F.count("*"), F.sum("n_rows"), F.count_distinct("batch_index")).first()
    assert tuple(big) == (100_001, 1_000_003, 100_001)
    with pytest.raises(Exception, match="at least 1 row"):
        batch_table(spark.createDataFrame([("a", 0)], "chunk_id string, total bigint"), 10).collect()
    small = batches.where("chunk_id = 'a'")
    samples = small.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    require_complete(batch_audit(small, samples))
    audit = batch_audit(small, samples.where("NOT (batch_index = 2 AND pos = 1)"))
    assert [(r.batch_index, r.got) for r in audit.where("NOT ok").collect()] == [(2, 4)]
    with pytest.raises(ValueError, match="asked for 5 rows and got 4"):
        require_complete(audit)


def _requests(spark, count):
    rows = [(i if i else None, "judge", f"text {i % 7}") for i in range(count)]
    return spark.createDataFrame(rows, "batch_id bigint, instructions string, message string")


def _counting_scorer(log, dies_at=None):
    """A scorer that writes down every call, and ends its process at the ``dies_at``-th call of all."""

    def make_scorer():
        def score(messages):
            with open(log, "a") as out:
                out.write(messages[-1]["content"] + "\n")
            if dies_at is not None and len(Path(log).read_text().splitlines()) >= dies_at:
                os._exit(1)
            repairs = sum(m["role"] == "assistant" for m in messages)
            if "text 3" in messages[1]["content"] and not repairs:
                return "no answer"
            if "text 5" in messages[1]["content"]:
                raise ConnectionError("refused")
            return '[{"index": 0, "is_valid": true, "score": 1.0, "issues": []}]'

        return score

    return make_scorer


def _answers(found):
    return sorted(((r.batch_id, r.attempts, r.error, r.scorer_error, r.text) for r in found.collect()), key=repr)


def test_a_killed_task_repeats_no_logged_call(spark, tmp_path):
    requests, journal = _requests(spark, 60), str(tmp_path / "journal")
    plain = _answers(run_scorer(requests, _counting_scorer(str(tmp_path / "plain")), partitions=1))
    assert len((tmp_path / "plain").read_text().splitlines()) == 60 + 9  # nine requests are repaired
    log = tmp_path / "log"
    with pytest.raises(Exception, match="(?i)worker|exited|crashed"):
        run_scorer(requests, _counting_scorer(str(log), 30), partitions=1, group=4, journal=journal)
    before = len(log.read_text().splitlines())
    assert before == 30
    logged = sum(len(f.read_text().splitlines()) for f in (tmp_path / "journal").rglob("*") if f.is_file())
    assert logged >= 20
    resumed = run_scorer(requests, _counting_scorer(str(log)), partitions=1, group=4, journal=journal)
    assert _answers(resumed) == plain
    failing = sum(i % 7 == 5 for i in range(60))
    calls = len(log.read_text().splitlines())
    # what was not logged is asked again: the open group, and calls that raised
    assert 69 + 30 - logged >= calls + 0 - failing and calls <= 69 + 4 + failing
    again = run_scorer(requests, _counting_scorer(str(log)), partitions=3, in_flight=4, journal=journal)
    assert _answers(again) == plain
    assert len(log.read_text().splitlines()) == calls + failing


def test_calls_in_flight(spark, tmp_path):
    """Four calls of a task wait for each other, so they must be open at the same time."""

    def make_scorer():
        def score(messages):
            name = tmp_path / messages[-1]["content"].replace(" ", "-")
            name.touch()
            for _ in range(200):
                if len(list(tmp_path.glob("in-flight-*"))) >= 4:
                    return "[]"
                time.sleep(0.05)
            return "alone"

        return score

    rows = [(i, "", f"in flight {i}") for i in range(4)]
    requests = spark.createDataFrame(rows, "batch_id bigint, instructions string, message string")
    found = run_scorer(requests, make_scorer, partitions=1, in_flight=4, max_calls=1)
    assert [r.text for r in found.collect()] == ["[]"] * 4


def test_half_written_lines_are_no_answers(tmp_path):
    journal = Journal(f"file:{tmp_path}/log")
    assert journal.read(3) == {}
    journal.write(3, [("a", "one\ntwo é"), ("b", None)])
    journal.write(3, [])
    (tmp_path / "log" / "3" / "torn").write_text('["c", "x"]\n["d", "ha')
    assert journal.read(3) == {"a": "one\ntwo é", "b": None, "c": "x"}
    assert journal.read(4) == {}
