"""JSON out of noisy responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgate.functions.json_text import clean_response, json_span
from rowgate.functions.text import PYTHON_WHITESPACE
from rowgate.operators import explode_samples, explode_verdicts, parse_payload, repair_requests, with_samples

from .common import Entry, table


def wrapped_documents(spark, sf_dir):
    """One response per document: reasoning block, fence, prose around JSON, or prose only."""
    number = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{ "id": '), number, F.lit(', "s": "a } b" }'))
    kind, text = F.col("doc_id") % 5, F.col("text")
    response = (
        F.when(kind == 0, F.concat(F.lit("\n <THINK>"), text, F.lit("{[</think>\n\t"), body))
        .when(kind == 1, F.concat(F.lit("Here: ```JSON\n"), body, F.lit("\n``` "), text))
        .when(kind == 2, F.concat(F.lit("  "), body, F.lit(" ] } "), text))
        .when(kind == 3, F.concat(text, F.lit("  \n")))
        .otherwise(F.concat(text, F.lit(' {"id": '), number, F.lit(', "s": [1, 2}')))
    )
    return table(spark, sf_dir, "documents").select("doc_id", response.alias("text"))


_SPACE = "'" + PYTHON_WHITESPACE + "'"
_WRAPPED = f"""
WITH r AS (
  SELECT doc_id, case doc_id % 5
    when 0 then chr(10) || ' <THINK>' || text || '{{[</think>' || chr(10) || chr(9) || '{{ "id": ' || doc_id || ', "s": "a }} b" }}'
    when 1 then 'Here: ```JSON' || chr(10) || '{{ "id": ' || doc_id || ', "s": "a }} b" }}' || chr(10) || '``` ' || text
    when 2 then '  {{ "id": ' || doc_id || ', "s": "a }} b" }} ] }} ' || text
    when 3 then text || ' ' || chr(8195) || chr(10)
    else text || ' {{"id": ' || doc_id || ', "s": [1, 2}}' end AS response
  FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(trim(response, {_SPACE}), '(?is)<think>.*?</think>', '', 'g'), {_SPACE}) AS c FROM r),
cleaned AS (
  SELECT doc_id, case when regexp_matches(c, '(?is)```(?:json)?(.*?)```')
    then trim(regexp_extract(c, '(?is)```(?:json)?(.*?)```', 1), {_SPACE}) else c end AS cleaned
  FROM t)
"""


def clean_text(spark, sf_dir):
    return wrapped_documents(spark, sf_dir).select("doc_id", clean_response(F.col("text")).alias("cleaned"))


_CLEAN_SQL = _WRAPPED + "SELECT doc_id, cleaned FROM cleaned"


def extract_span(spark, sf_dir):
    responses = wrapped_documents(spark, sf_dir).withColumn("cleaned", clean_response(F.col("text")))
    return responses.select("doc_id", json_span(F.col("cleaned")).alias("span"))


# prose of the documents holds no brackets, so the only payload is the one put in
_SPAN_SQL = """
SELECT doc_id, case when doc_id % 5 < 3 then '{"id":' || doc_id || ',"s":"a } b"}' end AS span FROM documents
"""


def parse_responses(spark, sf_dir):
    parsed = parse_payload(wrapped_documents(spark, sf_dir))
    return parsed.select("doc_id", "reason", F.try_variant_get("v", "$.id", "bigint").alias("id"))


_PARSE_SQL = """
SELECT doc_id, case doc_id % 5 when 3 then 'no_payload' when 4 then 'bad_json' end AS reason,
       case when doc_id % 5 < 3 then doc_id end AS id
FROM documents
"""


def sample_responses(spark, sf_dir):
    """Responses with two rows each, plain, wrapped or fenced; some are refused."""
    first = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("body")))
    second = F.to_json(F.struct((-F.col("doc_id")).alias("id"), F.col("lang").alias("body")))
    rows = F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]"))
    response = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"rows": '), rows, F.lit("}")))
        .when(F.col("doc_id") % 7 == 1, F.concat(F.lit("Sure. "), F.left(rows, F.length(rows) - 1)))
        .when(F.col("doc_id") % 7 == 2, F.lit("I cannot do that."))
        .when(F.col("doc_id") % 7 == 3, F.concat(F.lit('{"samples": '), rows, F.lit("}")))
        .when(F.col("doc_id") % 7 == 4, F.concat(F.lit("<think>[</think> ```json "), rows, F.lit("```")))
        .otherwise(rows)
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("batch_id"), response.alias("text"))


def exploded_samples(spark, sf_dir):
    samples = explode_samples(sample_responses(spark, sf_dir))
    return samples.select(
        "batch_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.try_variant_get("v", "$.id", "bigint").alias("id"),
        F.try_variant_get("v", "$.body", "string").alias("body"),
    )


_SAMPLES_SQL = """
SELECT doc_id AS batch_id, 0::BIGINT AS pos, doc_id AS id, text AS body FROM documents WHERE doc_id % 7 > 2
UNION ALL
SELECT doc_id, 1, -doc_id, lang FROM documents WHERE doc_id % 7 > 2
"""


def repairs(spark, sf_dir):
    refused = repair_requests(with_samples(sample_responses(spark, sf_dir)))
    return refused.select("batch_id", "message")


_REPAIR_SQL = """
SELECT doc_id AS batch_id, 'Your previous response could not be parsed as valid JSON. Parsing error: ' ||
    case doc_id % 7 when 0 then 'Expected a list of samples, got dict' when 1 then 'invalid JSON in response'
      else 'No JSON object/array payload found in response' end ||
    '. Return ONLY valid JSON (object or array), without markdown fences or explanation.' AS message
FROM documents WHERE doc_id % 7 < 3
"""


def verdict_rows(spark, sf_dir):
    """One response per label: a verdict with all entries, and one with defaults or faults."""
    valid = F.when(F.col("quality") == 1, "true").otherwise("false")
    full = F.concat(
        F.lit('{"index": 1, "is_valid": '), valid, F.lit(', "score": 0.'), F.col("toxic").cast("string"),
        F.lit('5, "issues": ["a", "b"]}'),
    )
    kind = F.col("doc_id") % 6
    short = (
        F.when(kind == 0, F.concat(F.lit('{"is_valid": '), valid, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"index": null, "is_valid": '), valid, F.lit("}")))
        .when(kind == 2, F.lit('{"index": 0}'))
        .when(kind == 3, F.concat(F.lit('{"index": 0, "is_valid": '), valid, F.lit(', "score": "x"}')))
        .when(kind == 4, F.lit("3"))
        .otherwise(F.lit(None))
    )
    response = F.when(kind == 5, F.lit('{"verdict": 1}')).otherwise(F.concat(F.lit("["), full, F.lit(", "), short, F.lit("]")))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("batch_id"), response.alias("text"))
    verdicts = explode_verdicts(labels)
    return verdicts.select(
        "batch_id", F.col("ord").cast("bigint").alias("ord"), "idx", "is_valid", "score",
        F.array_join("issues", ",").alias("issues"), "error",
    )


_VERDICTS_SQL = """
WITH l AS (SELECT doc_id AS batch_id, quality = 1 AS ok, toxic, doc_id % 6 AS kind FROM labels)
SELECT batch_id, 0::BIGINT AS ord, 1::BIGINT AS idx, ok AS is_valid,
       case when toxic = 1 then 0.15 else 0.05 end::DOUBLE AS score, 'a,b' AS issues, NULL::VARCHAR AS error
FROM l WHERE kind < 5
UNION ALL
SELECT batch_id, 1, case kind when 1 then NULL when 0 then 1 when 4 then 1 else 0 end,
       case when kind in (0, 1, 3) then ok end,
       case when kind = 3 then NULL when kind in (0, 1) and ok then 1.0 else 0.0 end,
       '',
       case kind when 1 then 'bad_index' when 2 then 'missing_is_valid' when 3 then case when ok then 'bad_score' end
         when 4 then 'parse_error' end
FROM l WHERE kind < 5
UNION ALL
SELECT batch_id, NULL, NULL, NULL, NULL, NULL, 'Expected a list of validation results, got dict' FROM l WHERE kind = 5
"""

QUERIES: dict[str, Entry] = {
    "clean_response": (clean_text, _CLEAN_SQL),
    "extract_json_span": (extract_span, _SPAN_SQL),
    "parse_payload": (parse_responses, _PARSE_SQL),
    "explode_samples": (exploded_samples, _SAMPLES_SQL),
    "repair_requests": (repairs, _REPAIR_SQL),
    "explode_verdicts": (verdict_rows, _VERDICTS_SQL),
}
