from __future__ import annotations

import json

import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import oracle_sql, queries
from rowgate.functions.row_checks import code_issues, with_field_issues, with_schema_issues
from rowgate.functions.text import python_float, python_string, strip
from rowgate.operators import is_valid, validate_rows
from rowgate.plans import Axis, CodeRule, Plan, Profile, schema_from_fields

PARCEL = {
    "type": "object",
    "properties": {
        "code": {"type": "string", "minLength": 4, "maxLength": 8},
        "kilos": {"type": "number", "minimum": 0.5, "maximum": 30},
        "route": {"type": "string", "enum": ["air", "sea", "road"]},
        "stops": {"type": "array", "minItems": 2, "maxItems": 3, "items": {"type": "integer", "minimum": 10}},
        "sender": {
            "type": "object",
            "properties": {"name": {"type": "string", "minLength": 1}, "floor": {"type": "integer", "maximum": 9}},
            "required": ["name"],
            "additionalProperties": False,
        },
    },
    "required": ["route", "code"],
    "additionalProperties": False,
}


def issues(json_rows, schema, *texts):
    checked = with_schema_issues(json_rows(texts), schema, value="v")
    return [row.issues for row in checked.orderBy("seq").collect()]


def test_nested_schema(json_rows):
    found = issues(
        json_rows,
        PARCEL,
        '{"code":"AB12","route":"sea","stops":[10,11],"sender":{"name":"N"},"kilos":30}',
        '{"kilos":0.25,"stops":[9],"glass":true}',
        '{"code":"ABCDEFGHI","route":"rail","stops":[10,"x",12,13]}',
        '{"code":7,"route":"air","sender":{"floor":12,"door":1}}',
        '{"code":"ABCD","route":"road","sender":"N","kilos":"heavy"}',
    )
    assert found == [
        [],
        [
            "$: missing required field 'route'",
            "$: missing required field 'code'",
            "$.kilos: value 0.25 below minimum 0.5",
            "$.stops: array too short (1 < 2)",
            "$.stops[0]: value 9 below minimum 10",
            "$: unexpected field 'glass'",
        ],
        [
            "$.code: string too long (9 > 8)",
            "$.route: value 'rail' not in enum ['air', 'sea', 'road']",
            "$.stops: array too long (4 > 3)",
            "$.stops[1]: expected integer, got str",
        ],
        [
            "$.code: expected string, got int",
            "$.sender: missing required field 'name'",
            "$.sender.floor: value 12 above maximum 9",
            "$.sender: unexpected field 'door'",
        ],
        ["$.kilos: expected number, got str", "$.sender: expected object, got str"],
    ]


def test_null_is_not_absent_and_booleans_count_as_numbers(json_rows):
    schema = {
        "type": "object",
        "properties": {"a": {"type": "string"}, "n": {"type": "number", "maximum": 0}, "i": {"type": "integer"}},
        "required": ["a"],
    }
    found = issues(json_rows, schema, '{"a":null,"n":true,"i":true}', "{}", '{"a":"","n":1}', '{"a":"","i":1.0}')
    assert found == [
        ["$.a: expected string, got NoneType", "$.i: expected integer, got bool"],
        ["$: missing required field 'a'"],
        ["$.n: value 1 above maximum 0"],
        ["$.i: expected integer, got float"],
    ]


def test_types_of_values(json_rows):
    values = {"str": '"x"', "int": "1", "float": "1.5", "bool": "true", "NoneType": "null", "list": "[1]", "dict": '{"a":1}'}
    fits = {"string": {"str"}, "integer": {"int"}, "number": {"int", "float", "bool"}, "boolean": {"bool"},
            "object": {"dict"}, "array": {"list"}, "null": {"NoneType"}}
    for kind, names in fits.items():
        found = issues(json_rows, {"properties": {"x": {"type": kind}}}, *[f'{{"x":{v}}}' for v in values.values()])
        assert found == [[] if n in names else [f"$.x: expected {kind}, got {n}"] for n in values]
    assert issues(json_rows, {"type": "object"}, "[1]", "3") == [
        ["$: expected object, got list"],
        ["$: expected object, got int"],
    ]
    assert issues(json_rows, {"properties": {"x": {"type": "date"}}}, '{"x":1}') == [
        ["$.x: unsupported schema type 'date'"]
    ]
    # a list of types is not looked at
    assert issues(json_rows, {"properties": {"x": {"type": ["string", "null"], "minLength": 2}}}, '{"x":1}', '{"x":"a"}') == [
        [],
        ["$.x: string too short (1 < 2)"],
    ]


def test_enum_compares_like_python(json_rows):
    choices = [1, "a", None, [1, {"b": 2}], 2.5]
    texts = ["1", "1.0", "true", '"a"', "null", '[1,{"b":2}]', "2.5", "2", '"b"', "false", "[1]", "-0.5"]
    found = issues(json_rows, {"properties": {"x": {"enum": choices}}}, *[f'{{"x":{t}}}' for t in texts])
    expected = []
    for text in texts:
        value = json.loads(text)
        expected.append([] if value in choices else [f"$.x: value {value!r} not in enum {choices!r}"])
    assert found == expected


def test_emoji_length_big_integers_and_float_text(json_rows):
    schema = {"properties": {"s": {"minLength": 5}, "n": {"type": "number", "maximum": 10}, "i": {"type": "integer"}}}
    found = issues(
        json_rows, schema, '{"s":"😀😀😀😀"}', '{"n":1e16}', '{"n":123456789.25}', '{"i":123456789012345678901234567890}'
    )
    assert found == [
        ["$.s: string too short (4 < 5)"],
        ["$.n: value 1e+16 above maximum 10"],
        ["$.n: value 123456789.25 above maximum 10"],
        [],
    ]


def test_items_of_mixed_and_nested_arrays(json_rows):
    schema = {"properties": {"x": {"type": "array", "maxItems": 3, "items": {"type": "string", "minLength": 2}}}}
    found = issues(json_rows, schema, '{"x":["aa",1,null]}', '{"x":["aa",null,"b"]}', '{"x":[]}', '{"x":["aa","bb","cc","d"]}')
    assert found == [
        ["$.x[1]: expected string, got int", "$.x[2]: expected string, got NoneType"],
        ["$.x[1]: expected string, got NoneType", "$.x[2]: string too short (1 < 2)"],
        [],
        ["$.x: array too long (4 > 3)", "$.x[3]: string too short (1 < 2)"],
    ]
    objects = {"properties": {"x": {"items": {"required": ["a"], "properties": {"a": {"items": {"type": "integer"}}},
                                              "additionalProperties": False}}}}
    assert issues(json_rows, objects, '{"x":[{"a":[1,"2"]},{"b":1},7]}') == [
        [
            "$.x[0].a[1]: expected integer, got str",
            "$.x[1]: missing required field 'a'",
            "$.x[1]: unexpected field 'b'",
        ]
    ]


def test_odd_field_names(json_rows):
    names = ["a.b", "it's", 'q"\\', "both ' and \"", "a]b", "", "é😀"]
    schema = {"properties": {name: {"type": "string"} for name in names}, "required": names}
    assert issues(json_rows, schema, json.dumps(dict.fromkeys(names, 1)), json.dumps(dict.fromkeys(names, ""))) == [
        [f"$.{name}: expected string, got int" for name in names],
        [],
    ]


def test_typed_columns_give_the_same_issues(spark, json_rows):
    shape = T.StructType.fromDDL(
        "code string, kilos double, route string, stops array<bigint>, sender struct<name: string, floor: bigint>, glass string"
    )
    texts = [
        '{"code":"A","kilos":31.5,"route":"rail","stops":[3],"sender":{"floor":10}}',
        '{"code":"ABCD","glass":"yes","stops":[]}',
        '{"code":"ABCD","kilos":0.5,"route":"air","stops":[10,20],"sender":{"name":"s"}}',
    ]
    typed = spark.createDataFrame(list(enumerate(texts)), "seq bigint, raw string").select(
        "seq", F.from_json("raw", shape).alias("r")
    ).select("seq", "r.*")
    checked = with_schema_issues(typed, PARCEL, columns=shape.fieldNames())
    assert [r.issues for r in checked.orderBy("seq").collect()] == issues(json_rows, PARCEL, *texts)
    as_null = with_schema_issues(typed, PARCEL, columns=["code", "kilos"], null_as="null").orderBy("seq").collect()
    assert as_null[1].issues == [
        "$: missing required field 'route'",
        "$.kilos: expected number, got NoneType",
    ]


def test_wide_schema(json_rows):
    names = [f"f{i}" for i in range(200)]
    schema = {
        "type": "object",
        "properties": {n: {"type": "integer", "minimum": 0, "maximum": 9} for n in names},
        "required": names,
        "additionalProperties": False,
    }
    row = {n: 1 for n in names}
    found = issues(json_rows, schema, json.dumps(row), json.dumps({**row, "f7": 10, "f150": "x"}))
    assert found == [[], ["$.f7: value 10 above maximum 9", "$.f150: expected integer, got str"]]


FIELDS = [
    {"name": "question", "field_type": "string", "constraints": {"min_length": 10, "max_length": 500}},
    {"name": "answer", "field_type": "string", "constraints": {"min_length": 5}},
    {"name": "difficulty", "field_type": "string"},
]


def flat_issues(json_rows, fields, *texts):
    return [r.issues for r in with_field_issues(json_rows(texts), fields, value="v").orderBy("seq").collect()]


def test_flat_check(json_rows):
    found = flat_issues(
        json_rows,
        FIELDS,
        '{"question":"What is the boiling point?","answer":"100 degrees","difficulty":"easy"}',
        '{"question":"What is H2O?","difficulty":"easy"}',
        '{"question":"Short?","answer":"Yes","difficulty":"easy"}',
        '{"question":12345,"answer":"An answer","difficulty":"easy","z":1,"b":2}',
    )
    assert found == [
        [],
        ["Missing field: answer"],
        ["Field question: too short (6 < 10)", "Field answer: too short (3 < 5)"],
        ["Field question: expected string, got int", "Unexpected fields: b, z"],
    ]
    kinds = [
        {"name": "i", "field_type": "integer", "constraints": {"max_value": 0}},
        {"name": "f", "field_type": "float", "constraints": {"min_value": 1}},
        {"name": "j", "field_type": "json"},
        {"name": "l", "field_type": "list[string]"},
        {"name": "u", "field_type": "unknown"},
    ]
    found = flat_issues(json_rows, kinds, '{"i":true,"f":false,"j":[1],"l":[1,2],"u":3}', '{"i":0.5,"f":"x","j":"s","l":{},"u":null}')
    assert found == [
        ["Field i: value True above maximum 0", "Field f: value False below minimum 1"],
        [
            "Field i: expected integer, got float",
            "Field i: value 0.5 above maximum 0",
            "Field f: expected float, got str",
            "Field j: expected json, got str",
            "Field l: expected list, got dict",
        ],
    ]


def test_code_rules(spark):
    def found(text, **rules):
        df = spark.createDataFrame([(text,)], "code string")
        return df.select(code_issues(F.col("code"), **rules)).first()[0]

    assert found('fn main() { println!("hi"); }', language="Python", disallowed=["println!"], required=["def "]) == [
        "Code does not appear to match declared language 'python'",
        "Disallowed substring found: println!",
        "Required substring missing: def ",
    ]
    assert found("def add(a, b):\n    return a + b", language="python", required=["def "]) == []
    assert found("print('hello')", language="cobol") == []
    assert found(" 　\n", language="python") == ["Code content is empty"]
    assert found(None, language="python", field="src") == ["Missing or invalid code field: src"]


def test_profile_rules_follow_schema_issues(json_rows):
    profile = Profile(
        "python_rows",
        "",
        {"type": "object", "properties": {"code": {"type": "string", "minLength": 40}}, "required": ["code"]},
        rules=(CodeRule("python", disallowed=("os.system(",), required=("def ",)),),
    )
    rows = json_rows(['{"code":"print(1); import os"}', '{"code":7}'])
    checked = validate_rows(rows, profile.plan(), profiles={profile.name: profile})
    assert [r.issues for r in checked.orderBy("seq").collect()] == [
        ["$.code: string too short (19 < 40)", "Required substring missing: def "],
        ["$.code: expected string, got int", "Missing or invalid code field: code"],
    ]
    with pytest.raises(ValueError, match="unknown profile"):
        validate_rows(rows, profile.plan())


def test_broken_json_is_invalid_even_without_a_plan(json_rows):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}]', "{'a':1}", '{"a":1},2', '{"a":"x\ny"}', "", '"s"', "{"]
    checked = validate_rows(json_rows(texts), None)
    assert [is_ok for (is_ok,) in checked.orderBy("seq").select(is_valid()).collect()] == [
        True, False, False, False, False, False, False, True, False,
    ]


def test_plan_documents():
    legacy = {
        "dataset_name": "qa", "description": "", "generation_strategy": "s", "num_samples": 20, "batch_size": 5,
        "fields": [
            {"name": "q", "field_type": "list[list[code]]", "description": "d", "constraints": {"language": "Rust", "min_length": 1}},
            {"name": "a", "field_type": "what", "description": "", "constraints": {"enum": ["x"]}},
        ],
    }
    plan = Plan.from_dict(legacy)
    assert plan.row_schema == {
        "type": "object",
        "properties": {
            "q": {"type": "array", "items": {"type": "array", "items": {"type": "string", "contentMediaType": "text/x-code"}},
                  "description": "d", "minLength": 1},
            "a": {"type": "string", "enum": ["x"]},
        },
        "required": ["q", "a"],
        "additionalProperties": False,
    }
    assert plan.field_names == ["q", "a"] and plan.rows_per_batch == 5
    assert Plan.from_dict(json.loads(plan.to_json())) == plan
    code = schema_from_fields([{"name": "c", "field_type": "code", "constraints": {"language": "Rust"}}])
    assert Plan("d", "", code).code_field == ("c", ".rs")
    with pytest.raises(ValueError, match="unknown values"):
        Axis("a", ["x"], {"y": 1.0})
    with pytest.raises(ValueError, match="sum to 1"):
        Axis("a", ["x", "y"], {"x": 0.5, "y": 0.4})
    with pytest.raises(ValueError):
        Plan("d", "", {"type": "array"})


def test_python_texts(spark):
    floats = [0.0, -0.0, 1.0, 1e15, 1e16, 1.5e-5, 0.0001, 123456789.125, 1e100, -2.5e-300, 0.1 + 0.2, float("inf"), float("nan")]
    df = spark.createDataFrame([(f,) for f in floats], "f double")
    assert [r[0] for r in df.selectExpr(python_float("f")).collect()] == [repr(f) for f in floats]
    strings = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "line\nbreak\t"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    assert [r[0] for r in df.selectExpr(python_string("s")).collect()] == [repr(s) for s in strings]
    padded = [" \t  x　\x1f\n", "​x", ""]
    df = spark.createDataFrame([(s,) for s in padded], "s string")
    assert [r[0] for r in df.select(strip(F.col("s"))).collect()] == [s.strip() for s in padded]


def test_text_compression_of_no_characters(spark, tmp_path):
    name = "profile_text_compression"
    texts = ["", "x", "twelve chars", "lorem ipsum " * 20]
    counted = [(i, texts[i % 4], 0) for i in range(60)] + [(60 + i, t, len(t)) for i, t in enumerate(texts[1:])]
    rows = spark.createDataFrame(counted, "doc_id bigint, text string, n_chars bigint")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    checked = queries()[name](spark, str(tmp_path))
    assert difference(checked, duck, oracle_sql()[name]) is None
    above = "$.target_ratio: value above maximum 0.9"
    assert checked.where(F.col("issues").contains(above)).where("doc_id < 60").count() == 60


def test_text_compression_of_nulls(spark, tmp_path):
    rows = [(0, None, 0), (1, None, 5), (2, "lorem ipsum " * 20, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["profile_text_compression"](spark, str(tmp_path)).orderBy("doc_id").collect()
    missing = [f"$: missing required field '{n}'" for n in ("source_text", "compressed_text", "target_ratio")]
    assert [row.issues for row in found] == ["; ".join(missing), "; ".join(missing), missing[2]]
