"""JSON array files read by ranges of bytes."""

from __future__ import annotations

import gzip
import json
import random

import pandas as pd
import pytest

from rowgate.sources import read_json_array, read_json_lines, read_rows
from rowgate.sources.arrays import _composed, elements, moves


def by_ranges(data: bytes, size: int) -> list[str]:
    """All elements, as tasks would find them that each have a range of ``size`` bytes."""
    starts = range(0, len(data), size)
    rows = [{"path": "f", "start": s, "first": data[s : s + size].lstrip(b" \t\n\r")[:1].decode("latin-1")} for s in starts]
    for row in rows:
        row["moves"] = [n for m in moves(data[row["start"] : row["start"] + size]) for n in m]
    states, out = _composed(pd.DataFrame(rows)), []
    for state in states.itertuples():
        rest = iter([data[i : i + 3] for i in range(state.start + size, len(data), 3)])
        part = data[state.start : state.start + size]
        out += elements(part, state.inside, state.escaped, state.depth, lambda: next(rest, b""), ValueError("not an array"))
    return out


def any_value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind == 5:
        return {rng.choice(['a"b', "c\\", "[", "é", ""]) + str(i): any_value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    if kind > 5:
        return [any_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return [1.0, None, -7, rng.choice(['x,y', '\\"', "]}", "\\\\", '"', "日本\\", "{[", "\n"]), True][min(kind, 4)]


@pytest.mark.parametrize("seed", range(150))
def test_any_range_size(seed):
    rng = random.Random(seed)
    values = [any_value(rng) for _ in range(rng.randint(0, 6))]
    text = json.dumps(values, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]))
    data = (rng.choice(["", " \n"]) + text + rng.choice(["", "\n\t "])).encode()
    for size in (1, 2, 3, 7, 20, len(data)):
        found = by_ranges(data, size)
        assert [json.loads(t) for t in found] == values
        assert found == by_ranges(data, len(data))


BROKEN = ["", " ", "{}", "[1,]", "[1,,2]", "[,1]", "[1] 2", "[1][2]", "[1", '["a]', "[{]}", "[1}", "x[1]", "[1 2]", '[tru]', "]", "[[1]", "[1]]", '"[1]"', "[\\]"]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_arrays_at_any_range_size(text):
    for size in range(1, len(text) + 1):
        with pytest.raises(ValueError, match="array"):
            by_ranges(text.encode(), size)


@pytest.mark.parametrize("text", BROKEN[1:])  # Spark leaves out files without a byte
def test_broken_files(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="expected a JSON array"):
        read_json_array(spark, str(tmp_path / "a.json")).collect()


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    values = [{"i": i, "text": 'é"\\ [' * (i % 40)} for i in range(2000)]
    texts = [json.dumps(v, ensure_ascii=False) for v in values]
    (tmp_path / "one.json").write_text("[" + ", ".join(texts) + "]")  # one line
    (tmp_path / "two.json").write_text(json.dumps(values, indent=2))
    (tmp_path / "small.json").write_text("[7]")
    rows = read_json_array(spark, [str(tmp_path / n) for n in ("one.json", "small.json", "two.json")], range_bytes=1000)
    found = rows.orderBy("seq").collect()
    assert [r.input_ord for r in found] == [0] * 2000 + [1] + [2] * 2000
    assert [r.raw for r in found[:2000]] == texts
    assert [json.loads(r.raw) for r in found[2001:]] == values
    assert rows.rdd.getNumPartitions() > 4
    assert len({r.seq["block"] for r in found[:2000]}) > 100


def test_packed_files_and_files_for_spark_alone(spark, tmp_path, monkeypatch):
    with gzip.open(tmp_path / "a.json.gz", "wt") as out:
        json.dump([{"a": 1}, "two"], out)
    (tmp_path / "b.json").write_text('[ {"b" : 1.0} ]')
    paths = [str(tmp_path / n) for n in ("b.json", "a.json.gz")]
    expected = [(0, '{"b" : 1.0}'), (1, '{"a": 1}'), (1, '"two"')]
    for readable in (True, False):
        monkeypatch.setattr("rowgate.sources.rows.reads_ranges", lambda spark, path, readable=readable: readable)
        assert [(r.input_ord, r.raw) for r in read_json_array(spark, paths).orderBy("seq").collect()] == expected


# many inputs in one scan


def lines_of(df):
    return [(r.input_ord, r.raw) for r in df.orderBy("seq").collect()]


def test_inputs_of_all_kinds_of_paths(spark, tmp_path):
    names = ["a b.jsonl", "c%20d.jsonl", "é[1].jsonl", "plus+x.jsonl"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"{i}\n\n{i}.5\n")
    for folder, line in (("run/day=1", "10"), ("flat", "20"), ("flat/sub", "21"), ("flat/_artifacts", "22")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "part.txt").write_text(line)
    at = lambda name: f"{tmp_path}/{name}"
    rows = read_json_lines(
        spark,
        [at("a b.jsonl"), at("run"), at("flat"), at("*.jsonl"), at("flat/_artifacts"), f"file://{at('flat/part.txt')}", at("a b.jsonl"), at("flat/../run")],
    )
    expected = [(0, "0"), (0, "0.5"), (1, "10"), (2, "20")]
    expected += [(3, f"{i}{part}") for i in (0, 1, 3, 2) for part in ("", ".5")]  # in the order of their names
    expected += [(4, "22"), (5, "20"), (6, "0"), (6, "0.5"), (7, "10")]
    assert lines_of(rows) == expected


def test_one_scan_for_many_inputs(spark, tmp_path):
    names = [f"{tmp_path}/chunk-{i:04}.jsonl" for i in range(500)]
    for i, name in enumerate(names):
        with open(name, "w") as out:
            out.write(f"{i}\n{i}\n")
    rows = read_rows(spark, [*names[250:], *names[:250], names[3]])
    assert rows._jdf.queryExecution().toString().count("FileScan text") == 1
    expected = [(k, str(i)) for k, i in enumerate([*range(250, 500), *range(250), 3]) for _ in range(2)]
    assert lines_of(rows) == expected


def test_mixed_kinds_keep_their_places(spark, tmp_path):
    for i, name in enumerate(["a.jsonl", "b.json", "c.jsonl", "d.json"]):
        (tmp_path / name).write_text(f'[{{"a":{i}}}]' if name.endswith(".json") else f'{{"a":{i}}}')
    spark.range(1).selectExpr("9 AS a").write.parquet(str(tmp_path / "e.parquet"))
    inputs = [str(tmp_path / n) for n in ("d.json", "c.jsonl", "e.parquet", "a.jsonl", "b.json")]
    assert lines_of(read_rows(spark, inputs)) == [(0, '{"a":3}'), (1, '{"a":2}'), (2, '{"a":9}'), (3, '{"a":0}'), (4, '{"a":1}')]


def test_more_inputs_than_one_scan_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rowgate.sources.inputs.INPUTS_PER_SCAN", 2)
    for i in range(5):
        (tmp_path / f"{i}.jsonl").write_text(str(i))
    inputs = [f"{tmp_path}/{i}.jsonl" for i in (4, 0, 3, 1, 2)]
    assert lines_of(read_json_lines(spark, inputs)) == list(enumerate("40312"))


def test_missing_input(spark, tmp_path):
    for path in (tmp_path / "none.jsonl", tmp_path / "none*.jsonl"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read_json_lines(spark, [str(path)])
