from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowgate.operators import merge_rows
from rowgate.plans import Plan
from rowgate.sinks import json_lines_to_columnar, write_json_lines, write_rows, write_run_artifacts
from rowgate.session import clear_staging, stage
from rowgate.sources import read_json_lines
from rowgate.streaming import arrivals, membership, merge_arrivals

CODE_PLAN = Plan(
    "code",
    "",
    {
        "type": "object",
        "properties": {
            "description": {"type": "string"},
            "code": {"type": "string", "contentMediaType": "text/x-code", "x-language": "python"},
            "meta": {"type": "object", "properties": {"n": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}},
        },
    },
)
TEXTS = [
    '{"code": "def a():\\n    pass", "description": "é😀", "meta": {"n": 1.0, "tags": ["x", "y"]}}',
    '{"description": "no code", "meta": {"n": 2, "tags": []}}',
    '{"code": "x = 1"}',
]


def lines_of(folder):
    return [line for part in sorted(Path(folder).glob("part-*")) for line in part.read_text().splitlines()]


def test_json_lines_keep_their_text(json_rows, tmp_path):
    path = write_json_lines(json_rows(TEXTS), str(tmp_path / "rows.jsonl"), ordered=True)
    assert lines_of(path) == TEXTS


def test_columnar(spark, json_rows, tmp_path):
    lines = write_rows(json_rows(TEXTS), str(tmp_path / "rows.jsonl"), "json")
    for path in (
        write_rows(json_rows(TEXTS), str(tmp_path / "direct"), "parquet", CODE_PLAN),
        json_lines_to_columnar(spark, lines, str(tmp_path / "converted"), CODE_PLAN),
    ):
        table = spark.read.parquet(path)
        assert table.columns == ["code", "description", "meta"]
        found = {r.code: r for r in table.collect()}
        assert found["x = 1"].meta is None and found["x = 1"].description is None
        assert found["def a():\n    pass"].meta.asDict() == {"n": 1.0, "tags": ["x", "y"]}
        assert found[None].meta.asDict() == {"n": 2.0, "tags": []}


def test_code_files(json_rows, tmp_path):
    folder = tmp_path / "code"
    write_rows(json_rows(TEXTS), str(folder), "code", CODE_PLAN)
    assert (folder / "sample_00000.py").read_text() == "def a():\n    pass"
    assert json.loads((folder / "sample_00001.json").read_text())["description"] == "no code"
    assert (folder / "sample_00002.py").read_text() == "x = 1"
    assert sorted(lines_of(folder / "manifest.jsonl")) == sorted(TEXTS)


def test_format_names(json_rows, tmp_path):
    rows = json_rows(TEXTS)
    for fmt, merged in (("xml", False), ("code", True)):
        with pytest.raises(ValueError, match="unknown output format"):
            write_rows(rows, str(tmp_path / "x"), fmt, merged=merged)
    with pytest.raises(ValueError, match="needs a plan"):
        write_rows(rows, str(tmp_path / "x"), "hf")


def test_artifacts(spark, json_rows, tmp_path):
    plan = Plan("k", "", {"type": "object", "properties": {"k": {"type": "integer"}}})
    merged = merge_rows(json_rows(['{"k":1}', '{"k":1}', '{"k":"x"}', "{oops \"q\""]), plan)
    paths = write_run_artifacts(merged, str(tmp_path / "out" / "run.jsonl"), plan, config={"min_score": 0.7})
    assert paths["artifacts_dir"].endswith("out/run_artifacts")
    assert lines_of(paths["accepted_jsonl"]) == ['{"k":1}']
    rejects = [json.loads(line) for line in lines_of(paths["rejected_jsonl"])]
    assert sorted(rejects, key=str) == sorted(
        [
            {"sample": {"k": 1}, "issues": ["duplicate_exact"], "score": 0.0},
            {"sample": {"k": "x"}, "issues": ["$.k: expected integer, got str"], "score": 0.0},
            {"sample": '{oops "q"', "issues": ["bad_json"], "score": 0.0},
        ],
        key=str,
    )
    assert json.loads(Path(paths["metrics_json"]).read_text())["rejected_count"] == 3
    assert Plan.from_dict(json.loads(Path(paths["plan_json"]).read_text())) == plan


def test_arriving_chunks_equal_one_merge(spark, tmp_path):
    plan = Plan("k", "", {"type": "object", "properties": {"k": {"type": "integer", "maximum": 90}}})
    folder = tmp_path / "in"
    folder.mkdir()
    chunks = [[f'{{"k":{k}}}' for k in ks] for ks in ([1, 2, 1, 99], [2, 3, 3], [99, 1, 4])]

    def run():
        base = tmp_path / "run"
        merge_arrivals(
            spark, str(folder), f"{base}/state", f"{base}/out", f"{base}/checkpoint", plan
        ).awaitTermination()
        return spark.read.parquet(f"{base}/out")

    for number, chunk in enumerate(chunks):
        (folder / f"chunk-{number}.jsonl").write_text("\n".join(chunk) + "\n")
        found = run()
    again = run()  # nothing new has arrived
    rows = sorted((r.raw, r.status) for r in found.collect())
    whole = merge_rows(read_json_lines(spark, str(folder)), plan, stage_checked=True)
    assert rows == sorted((r.raw, r.status) for r in whole.collect()) == sorted((r.raw, r.status) for r in again.collect())
    assert [s for _, s in rows].count("accepted") == 4


def test_staged_tables_are_in_the_shared_folder_and_can_be_cleared(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    staged = stage(spark.range(5).toDF("n"), "numbers")
    assert staged.count() == 5
    assert all(name.startswith(f"file://{root}") for name in staged.inputFiles())
    clear_staging(spark)
    assert not list(root.glob("rowgate-*"))
    clear_staging(spark)


@pytest.fixture
def arrivals_state(spark, tmp_path):
    """The state folder, and a function that merges a batch of numbers and returns them with their status."""
    state, output = str(tmp_path / "state"), str(tmp_path / "out")

    def arrive(batch, numbers):
        rows = [(json.dumps({"n": n}), "f", i) for i, n in enumerate(numbers)]
        df = spark.createDataFrame(rows, "raw string, file string, block_start bigint").coalesce(1)
        arrivals.merge_batch(df, batch, state, output)
        found = spark.read.parquet(f"{output}/batch={batch}").collect()
        return sorted((json.loads(r.raw)["n"], r.status) for r in found)

    return state, arrive


def test_state_of_arrivals_is_pruned_merged_and_freed(spark, arrivals_state, monkeypatch):
    monkeypatch.setattr(membership, "MERGED", 2)
    monkeypatch.setattr(membership, "BUCKET_KEYS", 50)
    state, arrive = arrivals_state
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*root.rglob("arrived-*"), *root.rglob("candidates-*")}
    for batch in range(5):
        fresh = range(batch * 200, batch * 200 + 200)
        expected = [(n, "accepted") for n in fresh] + ([(batch * 7, "duplicate")] if batch else [])
        assert arrive(batch, [*fresh, *([batch * 7] if batch else [])]) == sorted(expected)
        if batch == 4:  # a replay
            assert arrive(batch, [*fresh, batch * 7]) == sorted(expected)
    runs = membership.key_runs(spark, state, 5)
    assert [(r.first, r.last, r.bits) for r in runs] == [(0, 3, 4), (4, 4, 2)]
    keys = membership.run_keys(spark, runs)
    assert keys.count() == keys.distinct().count() == 1000
    assert {*root.rglob("arrived-*"), *root.rglob("candidates-*")} == before
    assert len(list(Path(state).iterdir())) == 2


def sha(*values):
    return [(hashlib.sha256(str(v).encode()).digest(),) for v in values]


def test_a_batch_reads_what_it_may_have_met(spark, tmp_path):
    """200 runs of 400 keys in 8 buckets each: new keys read no bucket, an old key reads its own."""
    state, runs = tmp_path / "state", []
    for number in range(200):
        keys = np.frombuffer(b"".join(k for (k,) in sha(*range(number * 400, number * 400 + 400))), np.uint8).reshape(-1, 32)
        run = membership.Run(number, number, 3, f"file:{state}/run={number}-{number}-3")
        folder = state / f"run={number}-{number}-3"
        (folder / "filters").mkdir(parents=True)
        for bucket in range(8):
            held = keys[keys[:, 0] >> 5 == bucket]
            (folder / "filters" / str(bucket)).write_bytes(membership.make_filter(held).tobytes())
            (folder / "keys" / f"bucket={bucket}").mkdir(parents=True)
            pq.write_table(pa.table({"key": [bytes(k) for k in held]}), folder / "keys" / f"bucket={bucket}" / "part.parquet")
        (folder / "keys" / "_SUCCESS").touch()
        runs.append(run)
    assert membership.key_runs(spark, str(state), 200) == sorted(runs)

    def met(*values):
        found = stage(membership.candidates(spark.createDataFrame(sha(*values), "key binary"), runs), "candidates")
        seen = membership.seen_keys(found, runs)
        return membership.candidate_folders(found, runs), [] if seen is None else sorted(bytes(r.key) for r in seen.collect())

    fresh = range(10**6, 10**6 + 300)
    folders, seen = met(*fresh)
    assert len(folders) <= 3 and seen == []  # 60,000 questions, of which one in 100,000 may be answered wrongly
    old = [5, 399, 400, 41_000, 79_999]
    folders, seen = met(*fresh, *old)
    assert 5 <= len(folders) <= 8 and seen == sorted(k for (k,) in sha(*old))
    assert {f.split("/run=")[1].split("-")[0] for f in folders} >= {"0", "1", "102", "199"}


def test_filters_deny_no_key():
    rng = np.random.default_rng(1)
    for count in (0, 1, 7, 1000, 70_000):
        keys = rng.integers(0, 256, (count, 32), np.uint8)
        words = membership.make_filter(keys)
        assert membership.may_hold(words, keys).all()
        assert membership.may_hold(words, rng.integers(0, 256, (100_000, 32), np.uint8)).sum() <= 20


def test_batches_without_keys(spark, arrivals_state):
    state, arrive = arrivals_state
    assert arrive(0, []) == []
    assert membership.key_runs(spark, state, 1) == []
    assert arrive(1, [1, 1]) == [(1, "accepted"), (1, "duplicate")]
    assert arrive(2, []) == []
    assert arrive(3, [1]) == [(1, "duplicate")]
