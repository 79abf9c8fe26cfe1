"""Order, keys, exact dedupe and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgate import Plan
from rowgate.functions.json_text import canonical_json, row_key
from rowgate.operators import dedupe_rows, merge_metrics, merge_rows
from rowgate.operators.merge import rejected
from rowgate.sources import order_key, read_columnar, rows_from_table, union_rows

from .common import Entry, joined, json_rows, table

TEXT_PLAN = Plan(
    "texts",
    "texts of usable length",
    {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 30, "maxLength": 8000}},
        "required": ["text"],
        "additionalProperties": False,
    },
)


def chunked_documents(spark, sf_dir):
    """Documents as three chunks; chunk number first, then document number, give the order."""
    documents = table(spark, sf_dir, "documents").withColumn("chunk", F.col("doc_id") % 3)
    return documents.withColumn("seq", order_key(documents, "chunk", "doc_id"))


def merge_status(spark, sf_dir):
    merged = merge_rows(chunked_documents(spark, sf_dir), TEXT_PLAN, columns=["text"])
    return merged.select("doc_id", "chunk", "status", joined(), "score")


_MERGED = """
WITH checked AS (
  SELECT doc_id, doc_id % 3 AS chunk, text, concat_ws('; ',
    case when length(text) < 30 then '$.text: string too short (' || length(text) || ' < 30)' end,
    case when length(text) > 8000 then '$.text: string too long (' || length(text) || ' > 8000)' end) AS issues
  FROM documents),
marked AS (
  SELECT *, case when issues <> '' then 'invalid'
    when row_number() OVER (PARTITION BY issues <> '', text ORDER BY chunk, doc_id) = 1 then 'accepted'
    else 'duplicate' end AS status
  FROM checked)
"""
_STATUS_SQL = _MERGED + """
SELECT doc_id, chunk, status, case status when 'duplicate' then 'duplicate_exact' else issues end AS issues,
       case when status <> 'accepted' then 0.0::DOUBLE end AS score
FROM marked
"""


def merge_status_json(spark, sf_dir):
    """The same merge over JSON rows, whose text is parsed and keyed in canonical form."""
    documents = chunked_documents(spark, sf_dir)
    rows = rows_from_table(documents, ["chunk", "doc_id"], ["text"])
    merged = merge_rows(rows, TEXT_PLAN)
    return merged.select(
        F.get_json_object("raw", "$.text").alias("text"), F.col("seq").cast("string").alias("seq"), "status", joined()
    )


_STATUS_JSON_SQL = _MERGED + """
SELECT text, (chunk::HUGEINT * 18446744073709551616 + doc_id)::VARCHAR AS seq, status,
       case status when 'duplicate' then 'duplicate_exact' else issues end AS issues
FROM marked
"""


def merge_counts(spark, sf_dir):
    return merge_metrics(merge_rows(chunked_documents(spark, sf_dir), TEXT_PLAN, columns=["text"]))


_COUNTS_SQL = _MERGED + """
SELECT count(*) AS raw_sample_count, count(*) FILTER (status = 'accepted') AS valid_count,
       count(*) FILTER (status <> 'accepted') AS rejected_count,
       count(*) FILTER (status = 'duplicate') AS duplicate_count,
       count(*) FILTER (status = 'invalid') AS invalid_count
FROM marked
"""


def dedupe_unique(spark, sf_dir):
    marked = dedupe_rows(table(spark, sf_dir, "documents"), columns=["text"], seq="doc_id")
    return marked.where("is_first").select("doc_id", "text", "lang")


_UNIQUE_SQL = """
SELECT doc_id, text, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
"""


def event_rows(spark, sf_dir):
    """Events as JSON text; every other row has its keys in another order and more blanks."""
    kind = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    one = F.concat(F.lit('{"type": '), kind, F.lit(', "props": '), F.col("props"), F.lit("}"))
    two = F.concat(F.lit('{ "props":'), F.col("props"), F.lit(' , "type":'), kind, F.lit(" }"))
    raw = F.when(F.col("event_id") % 2 == 0, one).otherwise(two)
    return json_rows(table(spark, sf_dir, "events"), "event_id", raw)


def dedupe_duplicates(spark, sf_dir):
    marked = dedupe_rows(event_rows(spark, sf_dir))
    return marked.where("NOT is_first").select(F.col("seq").alias("event_id"), "raw")


_DUPLICATES_SQL = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) AS n FROM events)
SELECT event_id, case when event_id % 2 = 0 then '{"type": "' || event_type || '", "props": ' || props || '}'
    else '{ "props":' || props || ' , "type":"' || event_type || '" }' end AS raw
FROM e WHERE n > 1
"""


def duplicate_rejects(spark, sf_dir):
    merged = merge_rows(chunked_documents(spark, sf_dir), columns=["text"])
    return rejected(merged).select("doc_id", joined(), "score")


_REJECTS_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, doc_id) AS n FROM documents)
SELECT doc_id, 'duplicate_exact' AS issues, 0.0::DOUBLE AS score FROM d WHERE n > 1
"""


def canonical_key(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    canonical = canonical_json(F.col("raw"), F.col("v"))
    return rows.select(
        F.col("seq").alias("event_id"),
        canonical.alias("canonical"),
        F.lower(F.hex(row_key(canonical))).alias("key"),
    )


_CANONICAL_SQL = """
WITH e AS (SELECT event_id, '{"props":{"k":' || (props->>'$.k') || '},"type":"' || event_type || '"}' AS canonical FROM events)
SELECT event_id, canonical, sha256(canonical) AS key FROM e
"""


def canonical_numbers(spark, sf_dir):
    """Integers and floats of equal size are different rows; spelling and key order are not."""
    orders = table(spark, sf_dir, "orders")
    whole = F.floor(F.col("o_totalprice") / 5000).cast("bigint").cast("string")
    forms = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"a":'), whole, F.lit(',"b":[1.50]}')))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('{"b":[1.5],"a":'), whole, F.lit("}")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit('{"b":[1.5],"a":'), whole, F.lit(".0}")))
        .otherwise(F.concat(F.lit('{"b":[15e-1],"a":'), whole, F.lit(".00}")))
    )
    marked = dedupe_rows(json_rows(orders, "o_orderkey", forms))
    return marked.select(F.col("seq").alias("o_orderkey"), "is_first")


_NUMBERS_SQL = """
SELECT o_orderkey, row_number() OVER (
    PARTITION BY floor(o_totalprice / 5000), o_orderkey % 4 < 2 ORDER BY o_orderkey) = 1 AS is_first
FROM orders
"""


def union_chunks(spark, sf_dir):
    inputs = [
        rows_from_table(table(spark, sf_dir, name).withColumnsRenamed({key: "id", text: "body"}), "id", ["id", "body"])
        for name, key, text in (
            ("pages", "page_id", "html"),
            ("documents", "doc_id", "text"),
            ("benchmark", "item_id", "text"),
        )
    ]
    return union_rows(*inputs).select(
        F.col("seq").cast("string").alias("seq"),
        "input_ord",
        F.try_variant_get("v", "$.body", "string").alias("body"),
    )


_UNION_SQL = """
WITH u AS (
  SELECT 0 AS input_ord, page_id AS id, html AS body FROM pages
  UNION ALL SELECT 1, doc_id, text FROM documents
  UNION ALL SELECT 2, item_id, text FROM benchmark)
SELECT (input_ord::HUGEINT * 18446744073709551616 + id)::VARCHAR AS seq, input_ord, body FROM u
"""


def table_rows(spark, sf_dir):
    rows = rows_from_table(table(spark, sf_dir, "orders"), "o_orderkey")
    return rows.select(
        F.col("seq").alias("o_orderkey"),
        F.try_variant_get("v", "$.o_orderdate", "string").alias("o_orderdate"),
        F.try_variant_get("v", "$.o_totalprice", "double").alias("o_totalprice"),
        F.schema_of_variant("v").contains("o_custkey: BIGINT").alias("has_custkey"),
    )


_TABLE_SQL = """
SELECT o_orderkey, cast(o_orderdate AS VARCHAR) AS o_orderdate, o_totalprice, true AS has_custkey FROM orders
"""


def scan_columnar(spark, sf_dir):
    rows = read_columnar(spark, f"{sf_dir}/documents.parquet")
    return rows.select(
        F.try_variant_get("v", "$.doc_id", "bigint").alias("doc_id"),
        F.try_variant_get("v", "$.text", "string").alias("text"),
        "input_ord",
    )


def dedupe_timestamps(spark, sf_dir):
    """Events at a time cut to tenths of a millisecond, of which some are equal and many are near."""
    events = table(spark, sf_dir, "events")
    micros = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 100 * 100")
    at = F.timestamp_micros(F.when(F.col("event_id") % 3 == 0, F.expr("1704067200000000 + (event_id % 1000) * 100")).otherwise(micros))
    rows = events.select("event_id", at.alias("at"), F.create_map(F.lit("k"), "event_type", F.lit("a"), F.lit("x")).alias("tags"))
    swapped = F.create_map(F.lit("a"), F.lit("x"), F.lit("k"), F.col("tags")["k"])
    rows = rows.withColumn("tags", F.when(F.col("event_id") % 2 == 0, swapped).otherwise(F.col("tags")))
    return dedupe_rows(rows, columns=["at", "tags"], seq="event_id").select("event_id", "is_first")


_TIMESTAMPS_SQL = """
WITH e AS (
  SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 1704067200000000 + (event_id % 1000) * 100
    ELSE epoch_us(ts) // 100 * 100 END AS cut
  FROM events)
SELECT event_id, row_number() OVER (PARTITION BY cut, event_type ORDER BY event_id) = 1 AS is_first FROM e
"""


def merge_keeps_columns(spark, sf_dir):
    """Events with columns that are named like the results of a merge."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("status"), F.col("value").alias("score"), F.col("user_id").alias("key"), F.col("props").alias("issues")
    )
    rules = {"type": "object", "properties": {"score": {"type": "number", "maximum": 50}}}
    merged = merge_rows(events, rules, columns=["status", "score"], seq="event_id", prefix="merge_")
    return merged.select("event_id", "status", "score", "key", "issues", "merge_status", F.size("merge_issues").alias("n_issues"))


_KEEPS_SQL = """
SELECT event_id, event_type AS status, value AS score, user_id AS key, props AS issues,
  CASE WHEN value > 50 THEN 'invalid'
    WHEN row_number() OVER (PARTITION BY event_type, value > 50, value ORDER BY event_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS merge_status,
  CASE WHEN value > 50 OR row_number() OVER (PARTITION BY event_type, value > 50, value ORDER BY event_id) > 1 THEN 1 ELSE 0 END AS n_issues
FROM events
"""

QUERIES: dict[str, Entry] = {
    "merge_status": (merge_status, _STATUS_SQL),
    "merge_status_json": (merge_status_json, _STATUS_JSON_SQL),
    "merge_metrics": (merge_counts, _COUNTS_SQL),
    "dedupe_unique": (dedupe_unique, _UNIQUE_SQL),
    "dedupe_duplicates": (dedupe_duplicates, _DUPLICATES_SQL),
    "duplicate_rejects": (duplicate_rejects, _REJECTS_SQL),
    "canonical_key": (canonical_key, _CANONICAL_SQL),
    "canonical_numbers": (canonical_numbers, _NUMBERS_SQL),
    "dedupe_timestamps": (dedupe_timestamps, _TIMESTAMPS_SQL),
    "merge_keeps_columns": (merge_keeps_columns, _KEEPS_SQL),
    "union_chunks": (union_chunks, _UNION_SQL),
    "rows_from_table": (table_rows, _TABLE_SQL),
    "scan_columnar": (scan_columnar, "SELECT doc_id, text, 0 AS input_ord FROM documents"),
}
