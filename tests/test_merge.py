from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from rowgate.operators import dedupe_rows, mark_first, merge_inputs, merge_metrics, merge_rows, number_rows
from rowgate.plans import Plan
from rowgate.sources import order_key, read_json_array, read_json_lines, read_rows, rows_from_table, union_rows

PLAN = Plan("t", "", {"type": "object", "properties": {"k": {"type": "integer", "maximum": 90}}, "required": ["k"]})


def canonical(text):
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def expected_status(texts, bad=lambda row: False):
    seen, found = set(), []
    for text in texts:
        key = canonical(text)
        if bad(json.loads(text)):
            found.append("invalid")
        else:
            found.append("duplicate" if key in seen else "accepted")
            seen.add(key)
    return found


def statuses(classified):
    return [r.status for r in classified.orderBy("seq").select("status").collect()]


def test_key_order_blanks_numbers_and_escapes(json_rows):
    texts = [
        '{"a":1,"b":"x"}', '{ "b" : "x", "a" : 1 }', '{"a":1.0,"b":"x"}', '{"a":1.00,"b":"x"}', '{"b":"x","a":1e0}',
        '{"a":2,"b":"y"}', '{"a":[1,1.0]}', '{"a":[1.0,1.0]}', '{"a":[1,1.00]}', '{"a":100.0}', '{"a":1e2}', '{"a":100}',
        '{"a":0.0}', '{"a":-0.0}', '{"a":0}', '{"a":-0}', '{"a":"\\u0041"}', '{"a":"A"}', '{"a":"1.0"}', '{"a":1.0}',
        '{"a":"x: 1.5, [2.0]"}', '{"a":"x: 1.5, [2.0]" }', '{"a":"\\u0001\\"\\\\ 1.5"}', '{"a":"\\u0001\\"\\\\ 1.5" }',
        '{"a":true}', '{"a":null}', "{}", '{"a":1,"a":2}', '{"a":2}', "1", "1.0", "-1.5", '"1.0"', "[]", "[[1.0]]", "[[1]]",
        '{"a":123456789012345678901234567890123456789012}', '{"a":123456789012345678901234567890123456789013}',
        '{"a":0.1}', '{"a":0.10}', '{"a":1E-7}', '{"a":0.0000001}', '{"é":"😀"}', '{"\\u00e9":"\\ud83d\\ude00"}',
    ]
    marked = dedupe_rows(json_rows(texts)).orderBy("seq").collect()
    assert [r.is_first for r in marked] == [s == "accepted" for s in expected_status(texts)]


def test_merge_without_and_with_plan(json_rows):
    texts = ['{"k":1}', '{"k":99}', '{"k":1}', '{"k":99}', '{"x":1}', '{"k":2}']
    assert statuses(merge_rows(json_rows(texts))) == expected_status(texts)
    merged = merge_rows(json_rows(texts), PLAN)
    assert statuses(merged) == ["accepted", "invalid", "duplicate", "invalid", "invalid", "accepted"]
    rows = {r.seq: r for r in merged.collect()}
    assert rows[2].issues == ["duplicate_exact"] and rows[2].score == 0.0
    assert rows[1].issues == ["$.k: value 99 above maximum 90"] and rows[0].score is None
    assert merge_metrics(merged).first().asDict() == {
        "raw_sample_count": 6, "valid_count": 2, "rejected_count": 4, "duplicate_count": 1, "invalid_count": 3,
    }


def test_empty_input(json_rows, spark):
    empty = json_rows(["{}"]).where("seq < 0")
    assert merge_metrics(merge_rows(empty, PLAN)).first().raw_sample_count == 0


@pytest.fixture
def chunk_files(tmp_path):
    """Three folders of two files each, with blank lines, many copies and both kinds of numbers."""
    source, texts = random.Random(7), []
    for chunk in range(3):
        folder = tmp_path / f"chunk {chunk}.jsonl"
        folder.mkdir()
        for part in range(2):
            lines = []
            for i in range(3000):
                k = source.randrange(100) if i % 3 else 5
                text = json.dumps({"k": k, "f": float(k) if i % 2 else k, "pad": "é" * source.randrange(9)})
                texts.append(text)
                lines.append(f"  {text} \n" + ("\n \t\n" if i % 40 == 0 else ""))
            (folder / f"part-{part}.txt").write_text("".join(lines))
    return [str(tmp_path / f"chunk {c}.jsonl") for c in range(3)], texts


@pytest.mark.parametrize("split", ["7KB", "70KB", "128MB"])
def test_merge_of_files_does_not_depend_on_splits(spark, chunk_files, split):
    inputs, texts = chunk_files
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], split)
        spark.conf.set(names[1], "4MB" if split == "128MB" else "5KB")
        rows = read_json_lines(spark, inputs)
        assert [r.raw for r in rows.orderBy("seq").collect()] == texts
        merged = merge_inputs(spark, inputs, PLAN)
        assert statuses(merged) == expected_status(texts, lambda row: row["k"] > 90)
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)



def test_repeated_and_nested_inputs(spark, chunk_files):
    inputs, texts = chunk_files
    one = texts[:6000]
    rows = read_json_lines(spark, [inputs[0], f"{inputs[0]}/part-1.txt", inputs[0]])
    assert [r.raw for r in rows.orderBy("seq").collect()] == one + one[3000:] + one


def test_quarantine_and_failfast(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"k":1}\n{"k":1} trailing\n\n{broken\n{"k":NaN}\r\n{"k":2}')
    merged = merge_inputs(spark, [str(path)], PLAN)
    assert statuses(merged) == ["accepted", "invalid", "invalid", "invalid", "accepted"]
    with pytest.raises(Exception, match="not valid JSON"):
        read_json_lines(spark, str(path), "failfast").collect()


def test_json_arrays(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('[{"a": 1.0, "b": "x"},\n "s", [1, 2.50], null, 3]')
    rows = read_json_array(spark, str(path)).orderBy("seq").collect()
    assert [json.loads(r.raw) for r in rows] == [{"a": 1.0, "b": "x"}, "s", [1, 2.5], None, 3]
    assert isinstance(json.loads(rows[0].raw)["a"], float)
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="expected a JSON array"):
        read_json_array(spark, str(tmp_path / "bad.json")).collect()
    lines = tmp_path / "more.jsonl"
    lines.write_text('"s"\n{"b":"x","a":1.0}\n{"b":"x","a":1}\n')
    merged = merge_inputs(spark, [str(path), str(lines)])
    assert statuses(merged) == ["accepted"] * 5 + ["duplicate", "duplicate", "accepted"]


def test_order_of_inputs_decides_which_copy_stays(spark):
    one = rows_from_table(spark.createDataFrame([(5, "b"), (9, "a")], "id bigint, t string"), "id", ["t"])
    two = rows_from_table(spark.createDataFrame([(1, "b"), (2, "c")], "id bigint, t string"), "id", ["t"])
    merged = merge_rows(union_rows(one, two)).orderBy("seq").collect()
    assert [(r.input_ord, r.status) for r in merged] == [
        (0, "accepted"), (0, "accepted"), (1, "duplicate"), (1, "accepted"),
    ]


def test_hot_key_and_negative_order(spark):
    """A third of the rows share a key; every row keeps its place and exactly one stays."""
    rows = spark.range(0, 90_000, numPartitions=8).select(
        (F.col("id") - 45_000).alias("seq"), F.when(F.col("id") % 3 == 1, -1).otherwise(F.col("id") % 500).alias("k")
    ).withColumn("key", F.sha2(F.col("k").cast("string"), 256))
    marked = mark_first(rows)
    first = marked.where("is_first").groupBy("k").agg(F.count("*").alias("n"), F.min("seq").alias("at"))
    everything = rows.groupBy("k").agg(F.min("seq").alias("at"))
    assert marked.count() == 90_000
    assert first.where("n <> 1").isEmpty()
    assert sorted((r.k, r.at) for r in first.collect()) == sorted((r.k, r.at) for r in everything.collect())


def test_dedupe_plan_moves_no_group_to_one_task(spark):
    rows = spark.range(1000).withColumn("key", (F.col("id") % 7).cast("string"))
    plan = mark_first(rows, seq="id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_" not in plan and "partial_min" in plan


def test_dedupe_of_unique_rows_changes_nothing(json_rows):
    texts = [f'{{"k":{i % 40}}}' for i in range(100)]
    once = merge_rows(json_rows(texts)).where("status = 'accepted'")
    again = merge_rows(json_rows([r.raw for r in once.orderBy("seq").collect()]))
    assert set(statuses(again)) == {"accepted"} and again.count() == 40


def test_order_key_of_several_columns(spark):
    df = spark.createDataFrame([(1, -5, "b"), (1, 3, "a"), (0, 2**62, "c")], "a int, b bigint, t string")
    pairs = df.withColumn("seq", order_key(df, "a", "b")).orderBy("seq").collect()
    assert [(r.a, r.b) for r in pairs] == [(0, 2**62), (1, -5), (1, 3)]
    mixed = df.withColumn("seq", order_key(df, "a", "t")).orderBy("seq").collect()
    assert [r.t for r in mixed] == ["c", "a", "b"]


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_row_numbers_are_dense_and_in_order(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003 - 100).alias("seq"))
        found = number_rows(rows).orderBy("seq").collect()
        assert [r.idx for r in found] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reading_a_run_folder_and_a_parquet_folder(spark, tmp_path):
    run = tmp_path / "run_artifacts"
    run.mkdir()
    (run / "accepted.jsonl").write_text('{"k":1}\n{"k":2}\n')
    spark.createDataFrame([(2,), (3,)], "k bigint").coalesce(1).write.parquet(str(tmp_path / "saved"))
    rows = read_rows(spark, [str(run), str(tmp_path / "saved")])
    assert statuses(merge_rows(rows)) == ["accepted", "accepted", "duplicate", "accepted"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reading_lines_moves_no_text(spark, chunk_files):
    """No exchange and no join before the parse, however many files there are."""
    plan = plan_text(read_json_lines(spark, chunk_files[0]))
    assert "Exchange" not in plan and "Join" not in plan


def test_mixed_inputs_merge(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":1}\n{"k":2}\n')
    (tmp_path / "b.json").write_text('[{"k":2}, {"k":3,"s":"a, [b"},\n"x"]')
    spark.createDataFrame([(1, "f"), (4, "g")], "k bigint, file string").write.parquet(str(tmp_path / "data.v2"))
    run = tmp_path / "run.1_artifacts"
    run.mkdir()
    (run / "accepted.jsonl").write_text('{"k":9}\n')
    inputs = [str(tmp_path / n) for n in ("a.jsonl", "b.json", "data.v2", "run.1_artifacts")]
    merged = merge_inputs(spark, inputs).orderBy("seq").collect()
    assert [(r.input_ord, r.raw, r.status) for r in merged] == [
        (0, '{"k":1}', "accepted"),
        (0, '{"k":2}', "accepted"),
        (1, '{"k":2}', "duplicate"),
        (1, '{"k":3,"s":"a, [b"}', "accepted"),
        (1, '"x"', "accepted"),
        (2, '{"k":1,"file":"f"}', "accepted"),
        (2, '{"k":4,"file":"g"}', "accepted"),
        (3, '{"k":9}', "accepted"),
    ]
    with_table = union_rows(read_rows(spark, inputs[:2]), rows_from_table(spark.range(3), "id"))
    assert [r.raw for r in with_table.orderBy("seq").collect()][-3:] == ['{"id":0}', '{"id":1}', '{"id":2}']
    assert [r.raw for r in read_rows(spark, inputs[1], fmt="jsonl").orderBy("seq").collect()][1] == '"x"]'
    with pytest.raises(ValueError, match="unknown input format"):
        read_rows(spark, inputs, fmt="csv")


@pytest.mark.parametrize("text", [" ", "{}", "[1", "[1,]", "[1] 2", "[1 2]", "[nope]"])
def test_broken_arrays_are_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="expected a JSON array|not valid"):
        read_json_array(spark, str(tmp_path / "x.json")).collect()


def test_long_texts_are_not_broken_rows(spark, tmp_path):
    """A string of 20 MiB passes as JSON as it does as a column; an array of 150 MB passes by its elements."""
    long = spark.range(1).selectExpr("id", "repeat('x', 20 * 1024 * 1024) AS t")
    for merged in (merge_rows(rows_from_table(long, "id")), merge_rows(long, PLAIN, columns=["t"], seq="id")):
        assert [r.status for r in merged.select("status").collect()] == ["accepted"]
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",".join(json.dumps({"n": i, "t": "y" * 15_000_000}) for i in range(10)) + "]")
    rows = read_json_array(spark, str(tmp_path / "big.json"))
    found = rows.selectExpr("try_variant_get(v, '$.n', 'int') AS n", "length(raw) AS size").orderBy("n").collect()
    assert [r.n for r in found] == list(range(10)) and all(r.size > 15_000_000 for r in found)


PLAIN = {"type": "object", "properties": {"t": {"type": "string"}}}


def test_typed_keys_are_exact(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES
        (1, TIMESTAMP'2024-01-01 00:00:00.123456', map('a', 1, 'b', 2), array(struct(map(1, 'x', 2, 'y') AS m))),
        (2, TIMESTAMP'2024-01-01 00:00:00.123999', map('a', 1, 'b', 2), array(struct(map(1, 'x', 2, 'y') AS m))),
        (3, TIMESTAMP'2024-01-01 00:00:00.123456', map('b', 2, 'a', 1), array(struct(map(2, 'y', 1, 'x') AS m))),
        (4, NULL, NULL, NULL), (5, NULL, NULL, NULL) AS t(seq, at, m, deep)"""
    )
    marked = dedupe_rows(rows, columns=["at", "m", "deep"]).orderBy("seq").collect()
    assert [r.is_first for r in marked] == [True, True, False, True, False]


def test_bare_strings_and_marks_have_keys_of_their_own(json_rows):
    texts = ['"a: 1.5"', '"a: 1.5"', '{"a":1.5}', '{"a":"\\u00011.5"}', '{"a":"\\u0001\\u00011.5"}', '{"b":["\\u0001",1.5]}', '{"b":["\\u0001", 1.50]}']
    merged = merge_rows(json_rows(texts)).orderBy("seq").collect()
    assert [r.status for r in merged] == ["accepted", "duplicate", "accepted", "accepted", "accepted", "accepted", "duplicate"]


def test_columns_of_the_rows_are_kept(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0.5, "k", True, "i", "s"), (2, "a", 0.5, "k", True, "i", "s"), (3, "b", 2.0, "k", True, "i", "s")],
        "seq bigint, text string, score double, key string, is_first boolean, issues string, status string",
    )
    rules = {"type": "object", "properties": {"score": {"type": "number", "maximum": 1}}}
    with pytest.raises(ValueError, match="already have"):
        merge_rows(rows, rules, columns=["text", "score"])
    merged = merge_rows(rows, rules, columns=["text", "score"], prefix="merge_").orderBy("seq")
    assert [tuple(r) for r in merged.select(rows.columns).collect()] == [tuple(r) for r in rows.orderBy("seq").collect()]
    assert [(r.merge_status, r.merge_issues) for r in merged.collect()] == [
        ("accepted", []),
        ("duplicate", ["duplicate_exact"]),
        ("invalid", ["$.score: value 2.0 above maximum 1"]),
    ]
    with pytest.raises(ValueError, match="already have"):
        dedupe_rows(rows, columns=["text"])
    assert dedupe_rows(rows, columns=["text"], into="only").where("only").count() == 2


def test_one_key_at_all_sizes(json_rows):
    """Rows of 25 million characters in other orders of their keys; floats and integers stay apart there too."""
    blank, text = " " * 500, "x" * 25_000_000
    rows = [
        f'{{"a": 1.0, "t": "{text}", "b": [1, 2.50]}}',
        f'{{"b":{blank}[1,2.50],"t":"{text}","a":1.0}}',
        f'{{"b": [1, 2.50], "t": "{text}", "a": 1}}',
        '{"parts": [' + ", ".join(f'"{"y" * 1000}"' for _ in range(20_000)) + '], "f": 1.50}',
        '{"f": 1.5, "parts": [' + ",".join(f'"{"y" * 1000}"' for _ in range(20_000)) + "]}",
    ]
    marked = dedupe_rows(json_rows(rows).repartition(5), stage_keyed=True)
    assert [r.is_first for r in marked.select("seq", "is_first").orderBy("seq").collect()] == [True, False, True, True, False]
