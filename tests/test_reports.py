from __future__ import annotations

import json
import random

import pytest

from rowgate import TEXT_COMPRESSION, Axis, Plan
from rowgate.operators import (
    axis_coverage,
    batch_audit,
    batch_targets,
    chunk_overlap,
    chunk_pairs,
    generation_requests,
    issue_profile,
    policy_filter,
    require_complete,
    source_repeats,
)


def test_issue_profile(spark):
    rows = [
        (["$.tags[3]: string too short (1 < 2)", "$.tags[14]: string too short (0 < 2)", "bad_json"],),
        (["$.kind: value 'it\\'s: [x]' not in enum ['a', 'b']", "$: missing required field 'a b'"],),
        (["$.n: value -1.5e-07 below minimum 0", "$.n: expected number, got str"],),
        ([],),
        (None,),
    ]
    found = {(r.code, r.path): r.n for r in issue_profile(spark.createDataFrame(rows, "issues array<string>")).collect()}
    assert found == {
        ("string too short (? < ?)", "$.tags[]"): 2,
        ("bad_json", ""): 1,
        ("value ? not in enum ?", "$.kind"): 1,
        ("missing required field", "$.a b"): 1,
        ("value ? below minimum ?", "$.n"): 1,
        ("expected number, got str", "$.n"): 1,
    }


def test_chunk_overlap_counts_against_the_first(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x"), (5, "b", "y"), (6, "a", "y"), (7, "c", "z"), (8, "c", None), (9, "c", None)]
    found = chunk_overlap(spark.createDataFrame(rows, "seq bigint, chunk string, key string"), "chunk")
    assert {(r.first_chunk, r.chunk): r.duplicates for r in found.collect()} == {("a", "a"): 1, ("a", "b"): 1, ("a", None): 1, ("b", "a"): 1}


def test_a_hot_text_does_not_make_pairs(spark):
    rows = spark.range(20_000).selectExpr("id AS seq", "'k' AS key", "id % 3 AS part")
    found = {(r.first_chunk, r.chunk): r.duplicates for r in chunk_overlap(rows, "part").collect()}
    assert found == {(0, 0): 6666, (0, 1): 6667, (0, 2): 6666}


def test_axis_coverage_of_json_rows(json_rows):
    rows = json_rows(['{"kind":"a","it\'s":1}', '{"kind":"b"}', '{"kind":null}', "[1]", '{"kind":"a"}'])
    axes = [Axis("kind", ["a", "c"], {"a": 1.0}), Axis("it's", ["1"])]
    found = {(r.axis, r.value): (r.declared, r.n, r.share, r.target_share, r.gap) for r in axis_coverage(rows, axes).collect()}
    assert found == {
        ("kind", "a"): (True, 2, 0.4, 1.0, -0.6),
        ("kind", "b"): (False, 1, 0.2, None, None),
        ("kind", "c"): (True, 0, 0.0, 0.0, 0.0),
        ("kind", None): (False, 2, 0.4, None, None),
        ("it's", "1"): (True, 1, 0.2, None, None),
        ("it's", None): (False, 4, 0.8, None, None),
    }
    with pytest.raises(ValueError):
        axis_coverage(rows, [])


def test_batch_targets_give_every_row_a_value(spark):
    batches = spark.createDataFrame([("x", i, i + 1) for i in range(60)], "chunk string, batch_index int, n_rows bigint")
    found = batch_targets(batches, [*TEXT_COMPRESSION.axes, Axis("none", [])]).collect()
    sums, counts = {}, {}
    for r in found:
        assert r["count"] >= 1
        sums[r.n_rows, r.axis] = sums.get((r.n_rows, r.axis), 0) + r["count"]
        counts[r.n_rows, r.value] = r["count"]
    assert all(total == n for (n, _), total in sums.items()) and len(sums) == 120
    shares = TEXT_COMPRESSION.axes[0].target_shares()
    assert all(abs(counts.get((n, v), 0) - n * s) < 1 for n in range(1, 61) for v, s in shares.items())
    assert {v: counts[20, v] for v in shares} == {"extractive": 5, "abstractive": 7, "bullet": 4, "telegraphic": 4}
    with pytest.raises(ValueError):
        batch_targets(batches, [Axis("none", [])])


def test_source_repeats(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate("aaabbc")] + [(7, None), (8, None)], "seq bigint, source string")
    found = source_repeats(rows, "source", 30).orderBy("first_seq").collect()
    assert [(r.n, r.first_seq, r.over) for r in found] == [(3, 0, True), (2, 3, False)]


def test_policy_filter(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id bigint")
    flags = spark.createDataFrame([(1, "bad"), (1, "bad"), (2, "fine"), (2, None), (None, "bad")], "id bigint, category string")
    assert sorted([r.id for r in policy_filter(rows, flags, ["bad"], "id").collect()], key=str) == [2, 3, None]
    assert policy_filter(rows, flags, [], "id").count() == 4


def test_audit_of_unnamed_chunks_and_surplus(spark):
    batches = spark.createDataFrame([(None, 0, 2), ("a", 0, 1), ("a", 1, 1)], "chunk_id string, batch_index bigint, n_rows bigint")
    samples = spark.createDataFrame([(None, 0), (None, 0), ("a", 0), ("b", 0), ("a", None)], "chunk_id string, batch_index bigint")
    found = {(r.chunk_id, r.batch_index): (r.expected, r.got, r.ok) for r in batch_audit(batches, samples).collect()}
    assert found == {
        (None, 0): (2, 2, True),
        ("a", 0): (1, 1, True),
        ("a", 1): (1, 0, False),
        ("b", 0): (0, 1, False),
        ("a", None): (0, 1, False),
    }
    with pytest.raises(ValueError, match="wrong batch size"):
        require_complete(batch_audit(batches.where("batch_index = 0"), samples))


def test_plans_keep_safety_and_constraints():
    data = {
        "dataset_name": "d",
        "description": "",
        "row_schema": {"type": "object", "properties": {}},
        "variation_spec": {"axes": [], "constraints": {"most": 2}},
        "safety": {"disallowed_categories": ["x"]},
    }
    plan = Plan.from_dict(data)
    assert plan.constraints == {"most": 2} and plan.disallowed_categories == ["x"]
    assert Plan.from_dict(json.loads(plan.to_json())) == plan
    assert TEXT_COMPRESSION.plan().constraints == {"max_duplicate_source_per_100": 2}


def test_targets_hold_over_a_run(spark):
    """After any number of batches each value has its share of the rows so far, rounded down or up."""
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 5, 7, 13]) for _ in range(300)]
    rows = [(f"c{i // 100}" if i < 200 else None, i % 100, n) for i, n in enumerate(sizes)]
    batches = spark.createDataFrame(rows, "chunk_id string, batch_index int, n_rows bigint").repartition(7)
    thirds = Axis("thirds", ["a", "b", "c"], {"a": 0.333, "b": 0.333, "c": 0.333})
    axes = [*TEXT_COMPRESSION.axes, thirds, Axis("lean", [str(i) for i in range(11)], {"0": 0.9, **{str(i): 0.01 for i in range(1, 11)}})]
    for per, runs in (((), [sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))]), (("chunk_id",), [rows[:100], rows[100:200], rows[200:]])):
        order = [c for c in ("chunk_id", "batch_index") if c not in per]
        found = {(r.chunk_id, r.batch_index, r.axis, r.value): r["count"] for r in batch_targets(batches, axes, order=order, per=per).collect()}
        assert min(found.values()) >= 1
        for axis in axes:
            shares = axis.target_shares() or {v: 1 / len(axis.values) for v in axis.values}
            whole = sum(shares.values())
            for run in runs:
                had, total = dict.fromkeys(shares, 0), 0
                for chunk, index, n in run:
                    got = {v: found.get((chunk, index, axis.name, v), 0) for v in shares}
                    assert sum(got.values()) == n
                    total += n
                    for v, k in got.items():
                        had[v] += k
                        assert abs(had[v] - total * shares[v] / whole) < 1


def test_targets_with_offsets_known_and_shares_without_a_period(spark):
    batches = spark.createDataFrame([(0, 10, 0), (1, 10, 10), (2, 10, 20)], "batch_index int, n_rows bigint, at bigint")
    axis = [Axis("x", ["a", "b"], {"a": 0.25, "b": 0.75})]
    known, summed = (batch_targets(batches, axis, order=["batch_index"], before=b).collect() for b in ("at", None))
    assert sorted(known) == sorted(summed)
    assert batch_targets(batches.limit(0), axis, order=["batch_index"]).collect() == []
    with pytest.raises(ValueError, match="whole"):
        batch_targets(batches, [Axis("x", ["a", "b"], {"a": 0.1234567, "b": 0.8765433})], order=["batch_index"])


def test_requests_say_the_targets(spark):
    schema = {"type": "object", "properties": {"t": {"type": "string"}}}
    plan = Plan("d", "", schema, axes=[Axis("style", ["plain", "it's"], {"plain": 0.5, "it's": 0.5}), Axis("tone", ["x"])])
    batches = spark.createDataFrame([("c", 0, 3), (None, 0, 1), ("d", 0, 2)], "chunk_id string, batch_index bigint, n_rows bigint")
    targets = batch_targets(batches.where("coalesce(chunk_id, '') <> 'd'"), plan.axes, order=["chunk_id", "batch_index"])
    plain = {r.chunk_id: r.message for r in generation_requests(batches, plan).collect()}
    found = {r.chunk_id: r.message for r in generation_requests(batches, plan, targets=targets).collect()}
    assert found == {
        None: plain[None] + " Rows by axis: style 'plain': 1; tone 'x': 1.",
        "c": plain["c"] + " Rows by axis: style 'plain': 1; style 'it's': 2; tone 'x': 3.",
        "d": plain["d"],
    }


def test_chunks_that_share_rows_first_seen_elsewhere(spark):
    """B and C share a row that A had first; a hot row is in every chunk; one chunk has no name."""
    texts = {"a": "xyzh", "b": "xqh", "c": "xqqrh", None: "hhx", "d": "w"}
    rows = [(c, t) for c, ts in texts.items() for t in ts] + [("a", "h")] * 500 + [("d", None)]
    found = {(r.chunk, r.other): r for r in chunk_pairs(spark.createDataFrame(rows, "part string, key string"), "part").collect()}
    sets = {c: set(ts) for c, ts in texts.items()}
    order = [None, "a", "b", "c", "d"]
    expected = {(one, two) for i, one in enumerate(order) for two in order[i + 1 :] if sets[one] & sets[two]}
    assert set(found) == expected and ("b", "c") in expected
    for (one, two), r in found.items():
        both = len(sets[one] & sets[two])
        assert (r["keys"], r.other_keys, r.shared, r.error) == (len(sets[one]), len(sets[two]), both, 0.0)
        assert r.containment == both / min(len(sets[one]), len(sets[two])) and r.jaccard == both / len(sets[one] | sets[two])


def test_estimates_of_shared_rows(spark):
    rows = spark.range(60_000).selectExpr("concat('k', id) AS key", "explode(filter(array(if(id < 40000, 'a', null), if(id >= 20000, 'b', null), if(id % 3 = 0, 'c', null)), x -> x IS NOT NULL)) AS part")
    exact = {(r.chunk, r.other): r.shared for r in chunk_pairs(rows, "part").collect()}
    assert exact == {("a", "b"): 20_000, ("a", "c"): 13_334, ("b", "c"): 13_333}
    for r in chunk_pairs(rows, "part", share=0.1).collect():
        assert 0 < r.error < 0.05 * r.shared
        assert abs(r.shared - exact[r.chunk, r.other]) < 4 * r.error
    with pytest.raises(ValueError):
        chunk_pairs(rows, "part", share=0)
