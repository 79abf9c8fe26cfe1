"""Row checks: schema keywords one by one, the flat check, code rules, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgate import TEXT_COMPRESSION, CodeRule, Plan, Profile
from rowgate.functions.row_checks import with_field_issues
from rowgate.operators import is_valid, split_rejects, typed_projection, validate_rows
from rowgate.plans import schema_from_fields
from rowgate.sources import rows_from_table

from .common import Entry, joined, json_rows, table


def _schema(**properties: dict) -> dict:
    return {"type": "object", "properties": properties}


DOCUMENT_SCHEMA = {
    **_schema(
        text={"type": "string", "minLength": 30, "maxLength": 8000},
        lang={"type": "string", "enum": ["en", "fr", "de"]},
        n_chars={"type": "integer", "minimum": 40, "maximum": 6000},
    ),
    "required": ["text", "lang", "title"],
    "additionalProperties": False,
}


def validate_schema(spark, sf_dir):
    rows = rows_from_table(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source", "n_chars"])
    return validate_rows(rows, DOCUMENT_SCHEMA).select(F.col("seq").alias("doc_id"), joined())


def validate_schema_typed(spark, sf_dir):
    columns = ["text", "lang", "source", "n_chars"]
    checked = validate_rows(table(spark, sf_dir, "documents"), DOCUMENT_SCHEMA, columns=columns)
    return checked.select("doc_id", joined())


_DOCUMENT_ISSUES = """
  concat_ws('; ',
    '$: missing required field ''title''',
    case when length(text) < 30 then '$.text: string too short (' || length(text) || ' < 30)' end,
    case when length(text) > 8000 then '$.text: string too long (' || length(text) || ' > 8000)' end,
    case when lang not in ('en', 'fr', 'de') then
      '$.lang: value ''' || lang || ''' not in enum [''en'', ''fr'', ''de'']' end,
    case when n_chars < 40 then '$.n_chars: value ' || n_chars || ' below minimum 40' end,
    case when n_chars > 6000 then '$.n_chars: value ' || n_chars || ' above maximum 6000' end,
    '$: unexpected field ''source''')
"""
_SCHEMA_SQL = f"SELECT doc_id, {_DOCUMENT_ISSUES} AS issues FROM documents"


def validate_type(spark, sf_dir):
    user = F.col("user_id").cast("string")
    kinds = (
        F.when(F.col("event_id") % 7 == 0, user)
        .when(F.col("event_id") % 7 == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(F.col("event_id") % 7 == 2, "true")
        .when(F.col("event_id") % 7 == 3, "null")
        .when(F.col("event_id") % 7 == 4, F.col("props"))
        .when(F.col("event_id") % 7 == 5, F.concat(F.lit("["), user, F.lit("]")))
        .otherwise(F.concat(user, F.lit(".0")))
    )
    raw = F.concat(F.lit('{"i": '), kinds, F.lit(', "n": '), kinds, F.lit("}"))
    rows = json_rows(table(spark, sf_dir, "events"), "event_id", raw)
    checked = validate_rows(rows, _schema(i={"type": "integer"}, n={"type": "number"}, x={"type": "date"}))
    return checked.select(F.col("seq").alias("event_id"), joined())


_TYPE_SQL = """
SELECT event_id, concat_ws('; ',
    case event_id % 7 when 1 then '$.i: expected integer, got str' when 2 then '$.i: expected integer, got bool'
      when 3 then '$.i: expected integer, got NoneType' when 4 then '$.i: expected integer, got dict'
      when 5 then '$.i: expected integer, got list' when 6 then '$.i: expected integer, got float' end,
    case event_id % 7 when 1 then '$.n: expected number, got str' when 3 then '$.n: expected number, got NoneType'
      when 4 then '$.n: expected number, got dict' when 5 then '$.n: expected number, got list' end) AS issues
FROM events
"""


def validate_enum(spark, sf_dir):
    rows = rows_from_table(table(spark, sf_dir, "orders"), "o_orderkey")
    schema = _schema(
        o_orderstatus={"type": "string", "enum": ["F", "O"]},
        o_orderpriority={"enum": ["1-URGENT", "2-HIGH", 3]},
    )
    return validate_rows(rows, schema).select(F.col("seq").alias("o_orderkey"), joined())


_ENUM_SQL = """
SELECT o_orderkey, concat_ws('; ',
    case when o_orderstatus not in ('F', 'O') then
      '$.o_orderstatus: value ''' || o_orderstatus || ''' not in enum [''F'', ''O'']' end,
    case when o_orderpriority not in ('1-URGENT', '2-HIGH') then
      '$.o_orderpriority: value ''' || o_orderpriority || ''' not in enum [''1-URGENT'', ''2-HIGH'', 3]' end) AS issues
FROM orders
"""


def validate_length(spark, sf_dir):
    schema = _schema(text={"type": "string", "minLength": 30, "maxLength": 8000})
    checked = validate_rows(table(spark, sf_dir, "documents"), schema, columns=["text"])
    return checked.select("doc_id", joined())


_LENGTH_SQL = """
SELECT doc_id, concat_ws('; ',
    case when length(text) < 30 then '$.text: string too short (' || length(text) || ' < 30)' end,
    case when length(text) > 8000 then '$.text: string too long (' || length(text) || ' > 8000)' end) AS issues
FROM documents
"""


def validate_range(spark, sf_dir):
    schema = _schema(o_totalprice={"type": "number", "minimum": 5000, "maximum": 400000.5})
    checked = validate_rows(table(spark, sf_dir, "orders"), schema, columns=["o_totalprice"])
    return checked.select("o_orderkey", joined())


_RANGE_SQL = """
SELECT o_orderkey, concat_ws('; ',
    case when o_totalprice < 5000 then '$.o_totalprice: value ' || o_totalprice || ' below minimum 5000' end,
    case when o_totalprice > 400000.5 then '$.o_totalprice: value ' || o_totalprice || ' above maximum 400000.5' end) AS issues
FROM orders
"""


def validate_items_count(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    schema = _schema(words={"type": "array", "minItems": 8, "maxItems": 900})
    return validate_rows(words, schema, columns=["words"]).select("doc_id", joined())


_ITEMS_COUNT_SQL = """
WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)
SELECT doc_id, concat_ws('; ',
    case when n < 8 then '$.words: array too short (' || n || ' < 8)' end,
    case when n > 900 then '$.words: array too long (' || n || ' > 900)' end) AS issues
FROM w
"""


def validate_items(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    rows = rows_from_table(words, "doc_id", ["words"])
    schema = _schema(words={"type": "array", "items": {"type": "string", "minLength": 2, "maxLength": 14}})
    return validate_rows(rows, schema).select(F.col("seq").alias("doc_id"), joined())


_ITEMS_SQL = """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(words) + 1), lambda i:
    case when length(words[i]) < 2 then '$.words[' || (i - 1) || ']: string too short (' || length(words[i]) || ' < 2)'
         when length(words[i]) > 14 then '$.words[' || (i - 1) || ']: string too long (' || length(words[i]) || ' > 14)'
    end), lambda x: x IS NOT NULL), '; ') AS issues
FROM w
"""


def validate_required(spark, sf_dir):
    kind = F.when(F.col("event_id") % 7 == 0, "").otherwise(
        F.concat(F.lit(', "type": "'), F.col("event_type"), F.lit('"'))
    )
    props = F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(F.col("props"))
    raw = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), kind, F.lit(', "props": '), props, F.lit("}"))
    rows = json_rows(table(spark, sf_dir, "events"), "event_id", raw)
    schema = {**_schema(props={"type": "object"}), "required": ["props", "type", "id"]}
    return validate_rows(rows, schema).select(F.col("seq").alias("event_id"), joined())


_REQUIRED_SQL = """
SELECT event_id, concat_ws('; ',
    case when event_id % 7 = 0 then '$: missing required field ''type''' end,
    '$: missing required field ''id''',
    case when event_id % 5 = 0 then '$.props: expected object, got NoneType' end) AS issues
FROM events
"""


def validate_object(spark, sf_dir):
    extra = F.when(F.col("event_id") % 3 == 0, F.lit(', "zz": 1, "aa": [2]')).otherwise("")
    raw = F.concat(
        F.lit('{"user": '), F.col("user_id").cast("string"), extra, F.lit(', "props": '), F.col("props"), F.lit("}")
    )
    rows = json_rows(table(spark, sf_dir, "events"), "event_id", raw)
    inner = {**_schema(k={"type": "integer", "maximum": 80}), "required": ["k", "j"], "additionalProperties": False}
    schema = {**_schema(props=inner, user={"type": "integer", "minimum": 10}), "additionalProperties": False}
    return validate_rows(rows, schema).select(F.col("seq").alias("event_id"), joined())


_OBJECT_SQL = """
WITH e AS (SELECT *, cast(props->>'$.k' AS BIGINT) AS k FROM events)
SELECT event_id, concat_ws('; ',
    '$.props: missing required field ''j''',
    case when k > 80 then '$.props.k: value ' || k || ' above maximum 80' end,
    case when user_id < 10 then '$.user: value ' || user_id || ' below minimum 10' end,
    case when event_id % 3 = 0 then '$: unexpected field ''aa''; $: unexpected field ''zz''' end) AS issues
FROM e
"""

# Plan of the older form; dates travel as text.
ORDER_FIELDS = [
    {"name": "o_orderkey", "field_type": "integer", "description": "key"},
    {"name": "o_orderstatus", "field_type": "string", "description": "", "constraints": {"enum": ["F", "O"]}},
    {"name": "o_totalprice", "field_type": "float", "description": "", "constraints": {"max_value": 450000}},
    {"name": "o_orderdate", "field_type": "string", "description": "", "constraints": {"max_length": 10}},
    {"name": "o_comment", "field_type": "string", "description": ""},
]


def validate_legacy_plan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    checked = validate_rows(orders, schema_from_fields(ORDER_FIELDS), columns=columns)
    return checked.select("o_orderkey", joined())


_LEGACY_SQL = """
SELECT o_orderkey, concat_ws('; ',
    '$: missing required field ''o_comment''',
    case when o_orderstatus not in ('F', 'O') then
      '$.o_orderstatus: value ''' || o_orderstatus || ''' not in enum [''F'', ''O'']' end,
    case when o_totalprice > 450000 then '$.o_totalprice: value ' || o_totalprice || ' above maximum 450000' end,
    case when length(cast(o_orderdate AS VARCHAR)) > 10 then
      '$.o_orderdate: string too long (' || length(cast(o_orderdate AS VARCHAR)) || ' > 10)' end,
    '$: unexpected field ''o_orderpriority''') AS issues
FROM orders
"""

EVENT_FIELDS = [
    {"name": "event_id", "field_type": "integer", "constraints": {"min_value": 100}},
    {"name": "event_type", "field_type": "code", "constraints": {"min_length": 5, "max_length": 6}},
    {"name": "value", "field_type": "integer", "constraints": {"max_value": 50}},
    {"name": "props", "field_type": "json"},
    {"name": "flag", "field_type": "boolean"},
]


def validate_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = rows_from_table(events, "event_id", ["event_id", "event_type", "value", "props", "user_id"])
    return with_field_issues(rows, EVENT_FIELDS, value="v").select(F.col("seq").alias("event_id"), joined())


_FIELDS_SQL = """
SELECT event_id, concat_ws('; ',
    case when event_id < 100 then 'Field event_id: value ' || event_id || ' below minimum 100' end,
    case when length(event_type) < 5 then 'Field event_type: too short (' || length(event_type) || ' < 5)' end,
    case when length(event_type) > 6 then 'Field event_type: too long (' || length(event_type) || ' > 6)' end,
    'Field value: expected integer, got float',
    case when value > 50 then 'Field value: value ' || value || ' above maximum 50' end,
    'Field props: expected json, got str',
    'Missing field: flag',
    'Unexpected fields: user_id') AS issues
FROM events
"""

HTML_RULE = CodeRule(
    language="TypeScript", code_field="html", disallowed=("&amp;", "onclick="), required=("<title>", "<table")
)
HTML_PROFILE = Profile(
    name="html_pages",
    description="pages",
    row_schema={**_schema(html={"type": "string", "maxLength": 3000}), "required": ["html"]},
    rules=(HTML_RULE,),
)


def code_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("issues", HTML_RULE(pages)).select("page_id", joined())


_MARKERS = " or ".join(f"contains(html, '{m}')" for m in ("function ", "const ", "let ", "interface ", "type "))
_CODE_ISSUES = f"""
    case when not ({_MARKERS}) then 'Code does not appear to match declared language ''typescript''' end,
    case when contains(html, '&amp;') then 'Disallowed substring found: &amp;' end,
    case when contains(html, 'onclick=') then 'Disallowed substring found: onclick=' end,
    case when not contains(html, '<title>') then 'Required substring missing: <title>' end,
    case when not contains(html, '<table') then 'Required substring missing: <table' end
"""
_CODE_SQL = f"SELECT page_id, concat_ws('; ', {_CODE_ISSUES}) AS issues FROM pages"


def profile_rules(spark, sf_dir):
    rows = rows_from_table(table(spark, sf_dir, "pages"), "page_id", ["html", "url"])
    checked = validate_rows(rows, HTML_PROFILE.plan(), profiles={HTML_PROFILE.name: HTML_PROFILE})
    return checked.select(F.col("seq").alias("page_id"), joined())


_PROFILE_SQL = f"""
SELECT page_id, concat_ws('; ',
    case when length(html) > 3000 then '$.html: string too long (' || length(html) || ' > 3000)' end,
    {_CODE_ISSUES}) AS issues
FROM pages
"""


def split_valid_rejected(spark, sf_dir):
    schema = _schema(text={"type": "string", "minLength": 30, "maxLength": 8000})
    checked = validate_rows(table(spark, sf_dir, "documents"), schema, columns=["text"])
    return split_rejects(checked).select(
        "doc_id", "status", F.size("issues").cast("bigint").alias("n_issues"), "score"
    )


_SPLIT_SQL = """
WITH d AS (SELECT doc_id, length(text) < 30 OR length(text) > 8000 AS bad FROM documents)
SELECT doc_id, case when bad then 'rejected' else 'valid' end AS status,
       cast(bad AS BIGINT) AS n_issues, case when bad then 0.0::DOUBLE end AS score
FROM d
"""


def text_compression(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    styles = F.array(*[F.lit(s) for s in ("extractive", "abstractive", "bullet", "telegraphic", "haiku")])
    domains = F.array(*[F.lit(s) for s in ("science", "news", "legal", "technical", "general", "sports")])
    short = F.left("text", F.lit(60))
    n_chars = F.col("n_chars")
    # No characters to compare with: above every bound, as the SQL's infinity and NaN (0 of 0) are.
    endless = (n_chars == 0) & short.isNotNull()
    pairs = documents.select(
        "doc_id",
        F.col("text").alias("source_text"),
        short.alias("compressed_text"),
        F.get(styles, (F.col("doc_id") % 5).cast("int")).alias("compression_style"),
        F.when(endless, float("inf")).otherwise(F.length(short) / n_chars).alias("target_ratio"),
        F.get(domains, (F.col("doc_id") % 6).cast("int")).alias("domain"),
    )
    checked = validate_rows(pairs, TEXT_COMPRESSION.plan(), columns=[c for c in pairs.columns if c != "doc_id"])
    shown = F.transform("issues", lambda x: F.regexp_replace(x, r"value (?:[0-9].*|inf) (below|above)", "value $1"))
    return checked.select("doc_id", is_valid().alias("valid"), F.array_join(shown, "; ").alias("issues"))


_COMPRESSION_SQL = """
WITH p AS (
  SELECT doc_id, text AS s, left(text, 60) AS c,
    ['extractive', 'abstractive', 'bullet', 'telegraphic', 'haiku'][doc_id % 5 + 1] AS style,
    length(left(text, 60)) / n_chars AS ratio,
    ['science', 'news', 'legal', 'technical', 'general', 'sports'][doc_id % 6 + 1] AS domain
  FROM documents),
q AS (SELECT doc_id, concat_ws('; ',
    case when length(s) < 30 then '$.source_text: string too short (' || length(s) || ' < 30)' end,
    case when length(c) < 10 then '$.compressed_text: string too short (' || length(c) || ' < 10)' end,
    case when style = 'haiku' then '$.compression_style: value ''haiku'' not in enum [''extractive'', ''abstractive'', ''bullet'', ''telegraphic'']' end,
    case when ratio < 0.1 then '$.target_ratio: value below minimum 0.1' end,
    case when ratio > 0.9 then '$.target_ratio: value above maximum 0.9' end,
    case when domain = 'sports' then '$.domain: value ''sports'' not in enum [''science'', ''news'', ''legal'', ''technical'', ''general'']' end) AS issues
  FROM p)
SELECT doc_id, issues = '' AS valid, issues FROM q
"""

DOCUMENT_PLAN = Plan(
    "documents",
    "documents",
    {**_schema(text={"type": "string"}, lang={"type": "string"}, n_chars={"type": "integer"}, doc_id={"type": "integer"})},
)


def project_documents(spark, sf_dir):
    rows = rows_from_table(table(spark, sf_dir, "documents"), "doc_id")
    return typed_projection(rows, DOCUMENT_PLAN, keep=())


QUERIES: dict[str, Entry] = {
    "validate_schema": (validate_schema, _SCHEMA_SQL),
    "validate_schema_typed": (validate_schema_typed, _SCHEMA_SQL),
    "validate_type": (validate_type, _TYPE_SQL),
    "validate_enum": (validate_enum, _ENUM_SQL),
    "validate_length": (validate_length, _LENGTH_SQL),
    "validate_range": (validate_range, _RANGE_SQL),
    "validate_items_count": (validate_items_count, _ITEMS_COUNT_SQL),
    "validate_items": (validate_items, _ITEMS_SQL),
    "validate_required": (validate_required, _REQUIRED_SQL),
    "validate_object": (validate_object, _OBJECT_SQL),
    "validate_legacy_plan": (validate_legacy_plan, _LEGACY_SQL),
    "validate_fields": (validate_fields, _FIELDS_SQL),
    "code_rules": (code_rules, _CODE_SQL),
    "profile_rules": (profile_rules, _PROFILE_SQL),
    "split_rejects": (split_valid_rejected, _SPLIT_SQL),
    "profile_text_compression": (text_compression, _COMPRESSION_SQL),
    "typed_projection": (project_documents, "SELECT doc_id, lang, n_chars, text FROM documents"),
}
