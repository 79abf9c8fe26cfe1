"""Batches, requests, verdicts, the quality gate, and generation bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgate import Plan
from rowgate.operators import (
    align_verdicts,
    apply_verdicts,
    batch_audit,
    batch_table,
    gate_metrics,
    generation_requests,
    number_rows,
    quality_gate,
    row_batches,
    run_scorer,
    score_requests,
)

from .common import Entry, table
from .merging import TEXT_PLAN

LABEL_PLAN = Plan(
    "labels", "label rows", {"type": "object", "properties": {"doc_id": {"type": "integer"}}}, batch_size=10
)


def _as_json(df):
    return df.select(F.col("doc_id").alias("seq"), F.to_json(F.struct("doc_id", "n_chars", "text")).alias("raw"))


def batched_documents(spark, sf_dir):
    return row_batches(table(spark, sf_dir, "documents"), 10, "doc_id").select("doc_id", "text", "batch_id", "pos", "batch_n")


_BATCHED_SQL = """
WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS total FROM documents)
SELECT doc_id, text, i // 10 AS batch_id, cast(i % 10 AS INTEGER) AS pos,
       cast(least(10, total - (i // 10) * 10) AS INTEGER) AS batch_n
FROM n
"""


def requests(spark, sf_dir):
    batched = row_batches(_as_json(table(spark, sf_dir, "documents")), 10)
    return score_requests(batched, LABEL_PLAN)


def requests_shown(spark, sf_dir):
    return requests(spark, sf_dir).select("batch_id", "n_rows", "message")


_REQUESTS = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
requests AS (
  SELECT i // 10 AS batch_id, count(*) AS n_rows,
    'Validate the following ' || count(*) || ' samples against the schema.' || chr(10) ||
    'For each sample, return: {"index": int, "is_valid": bool, "score": float (0-1), "issues": [str]}.' || chr(10) ||
    'Return a JSON array.' || chr(10) || chr(10) || 'Samples:' || chr(10) ||
    '[' || string_agg('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY doc_id) || ']' AS message
  FROM n GROUP BY i // 10)
"""


def make_stub():
    """A scorer factory; nested, so that it travels to the workers by value."""

    def stub_scorer():
        """Deterministic: fails some batches, and answers others only after a repair message."""
        import json

        def answer(messages):
            rows = json.loads(messages[1]["content"].split("Samples:\n")[1])
            kind = rows[0]["doc_id"] // 10 % 5
            if kind == 1:
                raise RuntimeError("no connection")
            if kind == 2 or (kind == 3 and len(messages) < 4):
                return "let me think"
            return json.dumps([{"index": i, "is_valid": row["n_chars"] >= 40} for i, row in enumerate(rows)])

        return answer

    return stub_scorer


def scorer_answers(spark, sf_dir):
    answers = run_scorer(requests(spark, sf_dir), make_stub(), partitions=16)
    return answers.select("batch_id", F.col("attempts").cast("bigint").alias("attempts"), "text", "error")


_SCORER_SQL = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
answers AS (
  SELECT i // 10 AS batch_id, min(doc_id) // 10 % 5 AS kind,
    '[' || string_agg('{"index": ' || (i % 10) || ', "is_valid": ' || (n_chars >= 40) || '}', ', ' ORDER BY doc_id) || ']' AS verdicts
  FROM n GROUP BY i // 10)
SELECT batch_id, case kind when 2 then 3 when 3 then 2 else 1 end::BIGINT AS attempts,
    case kind when 1 then NULL when 2 then 'let me think' else verdicts end AS text,
    case kind when 1 then 'RuntimeError: no connection'
      when 2 then 'No JSON object/array payload found in response' end AS error
FROM answers
"""


def labels_with_verdicts(spark, sf_dir, damaged: bool):
    """Label rows in batches of ten, and verdicts on them, in some batches with faults."""
    batched = row_batches(table(spark, sf_dir, "labels"), 10, "doc_id")
    fault, pos = (F.col("batch_id") % 7) if damaged else F.lit(-1), F.col("pos")
    verdicts = batched.select(
        "batch_id",
        F.when((fault == 2) & (pos == 0), 99).when((fault == 3) & (pos == 1), 0).otherwise(pos).cast("bigint").alias("idx"),
        F.when((fault == 4) & (pos == 2), F.lit(None)).otherwise(F.col("quality") == 1).alias("is_valid"),
        F.when((fault == 5) & (F.col("quality") == 1), F.lit(None)).when(F.col("toxic") == 1, 0.4).otherwise(0.7).alias("score"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("issues"),
    ).where(~((fault == 1) & (pos == 3)) & (fault != 6))
    return batched, verdicts


_LABELS = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels),
b AS (SELECT *, i // 10 AS batch_id, i % 10 AS pos, FAULT AS fault, count(*) OVER (PARTITION BY i // 10) AS batch_n FROM n),
v AS (
  SELECT batch_id, batch_n, fault,
    case when fault = 2 and pos = 0 then 99 when fault = 3 and pos = 1 then 0 else pos end AS idx,
    case when fault = 4 and pos = 2 then NULL else quality = 1 end AS is_valid,
    case when fault = 5 and quality = 1 then NULL when toxic = 1 then 0.4 else 0.7 end AS score,
    case when toxic = 1 then 'toxic' else '' end AS issues
  FROM b WHERE NOT (fault = 1 AND pos = 3) AND fault <> 6),
f AS (
  SELECT batch_id, case when count(*) <> max(batch_n) then 'count_mismatch'
    when bool_or(idx < 0 OR idx >= batch_n) then 'bad_index'
    when count(DISTINCT idx) < count(*) then 'duplicate_index'
    when bool_or(coalesce(is_valid AND score IS NULL, false)) then 'bad_score'
    when bool_or(is_valid IS NULL) then 'missing_is_valid' end AS batch_error
  FROM v GROUP BY batch_id),
a AS (
  SELECT b.doc_id, b.batch_id, b.pos, case when f.batch_id IS NULL then 'no_response' else f.batch_error end AS batch_error,
    v.is_valid, v.score, v.issues
  FROM b LEFT JOIN f USING (batch_id)
  LEFT JOIN v ON v.batch_id = b.batch_id AND v.idx = b.pos AND f.batch_error IS NULL)
"""
_DAMAGED = _LABELS.replace("FAULT", "(i // 10) % 7")
_INTACT = _LABELS.replace("FAULT", "-1")


def aligned(spark, sf_dir):
    rows = align_verdicts(*labels_with_verdicts(spark, sf_dir, True), 10)
    return rows.select(
        "doc_id", "batch_id", "pos", "batch_error",
        F.col("verdict_valid").alias("is_valid"), F.col("verdict_score").alias("score"),
        F.array_join("verdict_issues", "; ").alias("issues"),
    )


_ALIGNED_SQL = _DAMAGED + """
SELECT doc_id, batch_id, cast(pos AS INTEGER) AS pos, batch_error, is_valid, score::DOUBLE AS score, issues FROM a
"""


def _applied(spark, sf_dir, damaged):
    rows = apply_verdicts(align_verdicts(*labels_with_verdicts(spark, sf_dir, damaged), 10))
    return rows.select("doc_id", "status", "score", F.array_join("issues", "; ").alias("issues"))


def score_filter(spark, sf_dir):
    return _applied(spark, sf_dir, False)


def fail_closed(spark, sf_dir):
    return _applied(spark, sf_dir, True)


_APPLIED = """
SELECT doc_id,
  case when batch_error IS NULL AND is_valid AND score >= 0.7 then 'accepted' else 'rejected' end AS status,
  case when batch_error IS NULL then score else 0.0 end::DOUBLE AS score,
  case when batch_error IS NOT NULL then 'validator_error: ' || batch_error
       when is_valid AND score >= 0.7 then '' else issues end AS issues
FROM a
"""


def gated_documents(spark, sf_dir):
    """Documents through the gate in batches of two; documents without a label have no verdict."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def verdicts(batched):
        return batched.select("doc_id", "batch_id", "pos").join(labels, "doc_id").select(
            "batch_id",
            F.col("pos").cast("bigint").alias("idx"),
            (F.col("quality") == 1).alias("is_valid"),
            F.when(F.col("toxic") == 1, 0.4).otherwise(0.7).alias("score"),
            F.array(F.lit("judged")).alias("issues"),
        )

    plan = Plan(TEXT_PLAN.dataset_name, TEXT_PLAN.description, TEXT_PLAN.row_schema, batch_size=2)
    return quality_gate(documents, plan, verdicts, columns=["text"], seq="doc_id")


def gate(spark, sf_dir):
    return gated_documents(spark, sf_dir).select("doc_id", "status", "score", F.array_join("issues", "; ").alias("issues"))


_GATE = """
WITH c AS (
  SELECT doc_id, text, concat_ws('; ',
    case when length(text) < 30 then '$.text: string too short (' || length(text) || ' < 30)' end,
    case when length(text) > 8000 then '$.text: string too long (' || length(text) || ' > 8000)' end) AS found
  FROM documents),
n AS (SELECT c.*, (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS batch_id FROM c WHERE found = ''),
b AS (
  SELECT n.*, l.doc_id IS NOT NULL AS labelled, quality = 1 AS ok, case when toxic = 1 then 0.4 else 0.7 end AS score,
    count(*) OVER (PARTITION BY batch_id) AS size, count(l.doc_id) OVER (PARTITION BY batch_id) AS got
  FROM n LEFT JOIN labels l USING (doc_id)),
j AS (
  SELECT doc_id, text, batch_id, case when got = 0 then 'no_response' when got <> size then 'count_mismatch' end AS batch_error, ok, score,
    got = size AND ok AND score >= 0.7 AS passes FROM b),
m AS (SELECT *, passes AND row_number() OVER (PARTITION BY passes, text ORDER BY doc_id) > 1 AS copy FROM j),
gated AS (
  SELECT doc_id, batch_id, batch_error, case when copy then 'duplicate' when passes then 'accepted' else 'rejected' end AS status,
    case when batch_error IS NOT NULL or copy then 0.0 else score end::DOUBLE AS score,
    case when copy then 'duplicate_exact' when passes then '' when batch_error IS NOT NULL then 'validator_error: ' || batch_error
      else 'judged' end AS issues
  FROM m
  UNION ALL SELECT doc_id, NULL, NULL, 'rejected', 0.0, found FROM c WHERE found <> '')
"""
GATE = _GATE
_GATE_SQL = _GATE + "SELECT doc_id, status, score, issues FROM gated"


def run_metrics(spark, sf_dir):
    return gate_metrics(gated_documents(spark, sf_dir))


_METRICS_SQL = _GATE + """
SELECT count(*) AS raw_sample_count, count(*) FILTER (status = 'accepted') AS valid_count,
  count(*) FILTER (status <> 'accepted') AS rejected_count, count(*) FILTER (status = 'duplicate') AS duplicate_count,
  count(DISTINCT batch_id) FILTER (batch_error IS NOT NULL) AS validation_error_batches
FROM gated
"""


def source_totals(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.groupBy(F.col("source").alias("chunk_id")).agg(F.count("*").alias("total"))


def batches(spark, sf_dir):
    return batch_table(source_totals(spark, sf_dir), 7)


_BATCHES = """
WITH t AS (SELECT source AS chunk_id, count(*) AS total FROM documents GROUP BY source),
u AS (SELECT chunk_id, total, unnest(range((total + 6) // 7)) AS batch_index FROM t),
batches AS (SELECT chunk_id, batch_index, least(7, total - batch_index * 7) AS n_rows FROM u)
"""


def generation(spark, sf_dir):
    found = generation_requests(batches(spark, sf_dir), LABEL_PLAN)
    return found.select("chunk_id", "batch_index", "n_rows", "message")


_GENERATION_SQL = _BATCHES + """
SELECT chunk_id, batch_index, n_rows, 'Generate batch ' || (batch_index + 1) || ' with exactly ' || n_rows ||
  ' unique samples. Return a JSON array of ' || n_rows || ' sample objects. This run belongs to chunk ''' || chunk_id ||
  '''. Produce rows that are distinct from other chunks generated from the same plan.' AS message
FROM batches
"""


def audit(spark, sf_dir):
    """Batches of the documents of each chunk; short texts did not come back, and one chunk has no name.

    Rows of chunk 2 come back in batches of nine instead of seven, so some are surplus.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("third"))
    chunk = F.when(F.col("third") > 0, F.col("third").cast("string"))
    totals = documents.groupBy(chunk.alias("chunk_id")).agg(F.count("*").alias("total"))
    back = documents.where(F.length("text") >= 30)
    place = F.expr("doc_id div 3 div 7")
    surplus = back.where("third = 2 AND doc_id % 5 = 0").select(chunk.alias("chunk_id"), (place + 100_000).alias("batch_index"))
    samples = back.select(chunk.alias("chunk_id"), place.alias("batch_index")).unionByName(surplus)
    return batch_audit(batch_table(totals, 7), samples)


_AUDIT_SQL = """
WITH d AS (SELECT doc_id, text, doc_id % 3 AS third, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 3 AS VARCHAR) END AS chunk_id FROM documents),
t AS (SELECT chunk_id, count(*) AS total FROM d GROUP BY chunk_id),
u AS (SELECT chunk_id, total, unnest(range((total + 6) // 7)) AS batch_index FROM t),
asked AS (SELECT chunk_id, batch_index, least(7, total - batch_index * 7) AS n FROM u),
back AS (
  SELECT chunk_id, doc_id // 3 // 7 AS batch_index FROM d WHERE length(text) >= 30
  UNION ALL SELECT chunk_id, doc_id // 3 // 7 + 100000 FROM d WHERE length(text) >= 30 AND third = 2 AND doc_id % 5 = 0
), got AS (SELECT chunk_id, batch_index, count(*) AS n FROM back GROUP BY ALL)
SELECT coalesce(a.chunk_id, g.chunk_id) AS chunk_id, coalesce(a.batch_index, g.batch_index) AS batch_index,
  CAST(coalesce(a.n, 0) AS BIGINT) AS expected, CAST(coalesce(g.n, 0) AS BIGINT) AS got, coalesce(a.n, 0) > 0 AND coalesce(a.n, 0) = coalesce(g.n, 0) AS ok
FROM asked a FULL JOIN got g ON a.chunk_id IS NOT DISTINCT FROM g.chunk_id AND a.batch_index = g.batch_index
"""

QUERIES: dict[str, Entry] = {
    "row_batches": (batched_documents, _BATCHED_SQL),
    "score_requests": (requests_shown, _REQUESTS + "SELECT batch_id, n_rows, message FROM requests"),
    "run_scorer": (scorer_answers, _SCORER_SQL),
    "align_verdicts": (aligned, _ALIGNED_SQL),
    "score_filter": (score_filter, _INTACT + _APPLIED),
    "fail_closed": (fail_closed, _DAMAGED + _APPLIED),
    "quality_gate": (gate, _GATE_SQL),
    "run_metrics": (run_metrics, _METRICS_SQL),
    "batch_table": (batches, _BATCHES + "SELECT chunk_id, batch_index, n_rows FROM batches"),
    "generation_requests": (generation, _GENERATION_SQL),
    "batch_audit": (audit, _AUDIT_SQL),
}
