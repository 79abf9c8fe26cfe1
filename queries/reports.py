"""Reports: issues, chunk overlap, axes, sources and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgate import TEXT_COMPRESSION, Plan
from rowgate.operators import (
    axis_coverage,
    batch_table,
    batch_targets,
    chunk_overlap,
    chunk_pairs,
    issue_profile,
    key_of,
    policy_filter,
    source_repeats,
    validate_rows,
)

from .common import Entry, table

_DOCUMENT_RULES = {
    "type": "object",
    "properties": {
        "text": {"type": "string", "minLength": 300, "maxLength": 8000},
        "lang": {"type": "string", "enum": ["en", "fr"]},
        "n_chars": {"type": "integer", "maximum": 6000},
    },
    "required": ["text", "title"],
    "additionalProperties": False,
}


def issues(spark, sf_dir):
    columns = ["text", "lang", "n_chars", "source"]
    return issue_profile(validate_rows(table(spark, sf_dir, "documents"), _DOCUMENT_RULES, columns=columns))


_ISSUES_SQL = """
WITH i AS (
  SELECT unnest([
    CASE WHEN length(text) < 300 THEN ['string too short (? < ?)', '$.text'] END,
    CASE WHEN length(text) > 8000 THEN ['string too long (? > ?)', '$.text'] END,
    CASE WHEN lang NOT IN ('en', 'fr') THEN ['value ? not in enum ?', '$.lang'] END,
    CASE WHEN n_chars > 6000 THEN ['value ? above maximum ?', '$.n_chars'] END,
    ['missing required field', '$.title'], ['unexpected field', '$.source']]) AS i
  FROM documents)
SELECT i[1] AS code, i[2] AS path, count(*) AS n FROM i WHERE i IS NOT NULL GROUP BY ALL
"""


def overlap(spark, sf_dir):
    """Documents dealt into four chunks, one of which has no name."""
    documents = table(spark, sf_dir, "documents")
    chunk = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("part-"), (F.col("doc_id") % 4).cast("string")))
    rows = documents.select("doc_id", chunk.alias("part"), key_of(["text", "lang"]).alias("key"))
    return chunk_overlap(rows, "part", seq="doc_id")


_OVERLAP_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN 'part-' || doc_id % 4 END AS chunk,
    first_value(doc_id) OVER (PARTITION BY text, lang ORDER BY doc_id) AS first_id
  FROM documents)
SELECT f.chunk AS first_chunk, d.chunk AS chunk, count(*) AS duplicates
FROM d JOIN d f ON f.doc_id = d.first_id WHERE d.doc_id <> d.first_id GROUP BY ALL
"""


def pairs(spark, sf_dir):
    """Texts that every two of nine chunks share, one of which has no name."""
    documents = table(spark, sf_dir, "documents")
    chunk = F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("part-"), (F.col("doc_id") % 9).cast("string")))
    found = chunk_pairs(documents.select(chunk.alias("part"), key_of(["text"]).alias("key")), "part")
    return found.select("chunk", "other", "keys", "other_keys", "shared", F.round("containment", 9).alias("containment"), F.round("jaccard", 9).alias("jaccard"))


_PAIRS_SQL = """
WITH d AS (SELECT DISTINCT CASE WHEN doc_id % 9 > 0 THEN 'part-' || doc_id % 9 ELSE '' END AS chunk, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT chunk, count(*) AS keys FROM d GROUP BY chunk),
s AS (SELECT a.chunk, b.chunk AS other, count(*) AS shared FROM d a JOIN d b ON a.text = b.text AND a.chunk < b.chunk GROUP BY ALL)
SELECT nullif(s.chunk, '') AS chunk, s.other, n.keys, m.keys AS other_keys, shared, round(shared / least(n.keys, m.keys)::DOUBLE, 9) AS containment,
  round(shared / (n.keys + m.keys - shared)::DOUBLE, 9) AS jaccard
FROM s JOIN n ON n.chunk = s.chunk JOIN n AS m ON m.chunk = s.other
"""

_STYLES = ["extractive", "abstractive", "bullet", "telegraphic"]
_DOMAINS = ["science", "news", "legal", "technical", "general"]


def coverage(spark, sf_dir):
    """Styles and domains of documents; some have a style that no plan knows, and one domain never occurs."""
    doc_id = F.col("doc_id")
    style = F.element_at(F.array(*map(F.lit, [*_STYLES, "haiku"])), (doc_id % 5 + 1).cast("int"))
    domain = F.element_at(F.array(*map(F.lit, _DOMAINS[:4])), (doc_id % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        style.alias("compression_style"), F.when(doc_id % 7 > 0, domain).alias("domain")
    )
    return axis_coverage(rows, TEXT_COMPRESSION.axes, value=None)


_COVERAGE_SQL = """
WITH p AS (
  SELECT ['extractive', 'abstractive', 'bullet', 'telegraphic', 'haiku'][doc_id % 5 + 1] AS style,
    CASE WHEN doc_id % 7 > 0 THEN ['science', 'news', 'legal', 'technical'][doc_id % 4 + 1] END AS domain
  FROM documents),
seen AS (
  SELECT 'compression_style' AS axis, style AS value, count(*) AS n FROM p GROUP BY style
  UNION ALL SELECT 'domain', domain, count(*) FROM p GROUP BY domain),
wanted(axis, value, target_share) AS (VALUES
  ('compression_style', 'extractive', 0.25::DOUBLE), ('compression_style', 'abstractive', 0.35::DOUBLE),
  ('compression_style', 'bullet', 0.2::DOUBLE), ('compression_style', 'telegraphic', 0.2::DOUBLE),
  ('domain', 'science', NULL), ('domain', 'news', NULL), ('domain', 'legal', NULL), ('domain', 'technical', NULL), ('domain', 'general', NULL)),
met AS (
  SELECT coalesce(s.axis, w.axis) AS axis, coalesce(s.value, w.value) AS value, w.axis IS NOT NULL AS declared,
    coalesce(n, 0) AS n, target_share
  FROM seen s FULL JOIN wanted w ON s.axis = w.axis AND s.value = w.value),
shares AS (SELECT *, n / CAST((SELECT count(*) FROM p) AS DOUBLE) AS share FROM met)
SELECT axis, value, declared, CAST(n AS BIGINT) AS n, share, target_share, share - target_share AS gap FROM shares
"""


def _batches_of_sources(spark, sf_dir):
    totals = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("chunk_id")).agg(F.count("*").alias("total"))
    return batch_table(totals, 7)


def targets(spark, sf_dir):
    """Batches of seven documents of all sources in a row, dealt to styles by share and to domains evenly over the run."""
    return batch_targets(_batches_of_sources(spark, sf_dir), TEXT_COMPRESSION.axes, order=["chunk_id", "batch_index"])


def targets_of_chunks(spark, sf_dir):
    """The same with a run per source."""
    return batch_targets(_batches_of_sources(spark, sf_dir), TEXT_COMPRESSION.axes, order=["batch_index"], per=["chunk_id"])


def targets_by_batch(spark, sf_dir):
    """The same, with every batch dealt by itself."""
    return batch_targets(_batches_of_sources(spark, sf_dir), TEXT_COMPRESSION.axes)


# The value of each row of a period (of 20 rows for styles, of 5 for domains): of the values that may have one more row,
# that whose next one is due first.
_RUN_SQL = """
WITH RECURSIVE t AS (SELECT source AS chunk_id, count(*) AS total FROM documents GROUP BY source),
u AS (SELECT chunk_id, total, unnest(range((total + 6) // 7)) AS batch_index FROM t),
b AS (SELECT chunk_id, batch_index, least(7, total - batch_index * 7) AS n_rows FROM u),
r AS (SELECT *, coalesce(sum(n_rows) OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM b),
axes(axis, names, wants, period) AS (VALUES
  ('compression_style', ['extractive', 'abstractive', 'bullet', 'telegraphic'], [5, 7, 4, 4], 20),
  ('domain', ['science', 'news', 'legal', 'technical', 'general'], [1, 1, 1, 1, 1], 5)),
d(axis, names, wants, period, row, given) AS (
  SELECT axis, names, wants, period, 0, list_transform(wants, lambda w: 0) FROM axes
  UNION ALL
  SELECT axis, names, wants, period, row + 1, list_transform(given, lambda g, i: g + CASE WHEN i = pick THEN 1 ELSE 0 END)
  FROM (
    SELECT *, list_position(due, list_min(due)) AS pick FROM (
      SELECT *, list_transform(wants, lambda w, i: CASE WHEN given[i] * period < w * (row + 1)
        THEN ((given[i] + 1) * period + w - 1) // w ELSE 1000000 END) AS due
      FROM d WHERE row < period))),
q AS (SELECT axis, period, row, unnest(names) AS value, unnest(wants) AS want, unnest(given) AS given FROM d),
c AS (
  SELECT chunk_id, batch_index, n_rows, x.axis, x.value,
    ((low + n_rows) // x.period) * x.want + y.given - (low // x.period) * x.want - x.given AS count
  FROM r JOIN q AS x ON x.row = low % x.period
  JOIN q AS y ON y.axis = x.axis AND y.value = x.value AND y.row = (low + n_rows) % y.period)
SELECT chunk_id, batch_index, n_rows, axis, value, CAST(count AS BIGINT) AS count FROM c WHERE count > 0
"""
_ALL_SQL = _RUN_SQL.replace("{run}", "ORDER BY chunk_id, batch_index")
_CHUNKS_SQL = _RUN_SQL.replace("{run}", "PARTITION BY chunk_id ORDER BY batch_index")

_TARGETS_SQL = """
WITH t AS (SELECT source AS chunk_id, count(*) AS total FROM documents GROUP BY source),
u AS (SELECT chunk_id, total, unnest(range((total + 6) // 7)) AS batch_index FROM t),
b AS (SELECT chunk_id, batch_index, least(7, total - batch_index * 7) AS n_rows FROM u),
shares(axis, k, value, share) AS (VALUES
  ('compression_style', 0, 'extractive', 0.25::DOUBLE), ('compression_style', 1, 'abstractive', 0.35::DOUBLE),
  ('compression_style', 2, 'bullet', 0.2::DOUBLE), ('compression_style', 3, 'telegraphic', 0.2::DOUBLE),
  ('domain', 0, 'science', 0.2::DOUBLE), ('domain', 1, 'news', 0.2::DOUBLE), ('domain', 2, 'legal', 0.2::DOUBLE),
  ('domain', 3, 'technical', 0.2::DOUBLE), ('domain', 4, 'general', 0.2::DOUBLE)),
e AS (SELECT *, n_rows * share AS exact, CAST(floor(n_rows * share + 1e-9) AS BIGINT) AS whole FROM b, shares),
r AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id, batch_index, axis ORDER BY round(exact - whole, 9) DESC, k) AS place,
    n_rows - sum(whole) OVER (PARTITION BY chunk_id, batch_index, axis) AS more
  FROM e)
SELECT chunk_id, batch_index, n_rows, axis, value, CAST(whole + CASE WHEN place <= more THEN 1 ELSE 0 END AS BIGINT) AS count
FROM r WHERE whole > 0 OR place <= more
"""


def repeats(spark, sf_dir):
    most = TEXT_COMPRESSION.constraints["max_duplicate_source_per_100"]
    pairs = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("source_text"))
    return source_repeats(pairs, "source_text", most / 10)


_REPEATS_SQL = """
SELECT sha256(CAST(user_id AS VARCHAR)) AS source_hash, count(*) AS n, min(event_id) AS first_seq,
  count(*) * 100 > 0.2::DOUBLE * (SELECT count(*) FROM events) AS over
FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1
"""


def policy(spark, sf_dir):
    """Documents whose labels do not name a category that the plan rules out."""
    plan = Plan.from_dict(
        {
            "dataset_name": "documents",
            "description": "",
            "row_schema": {"type": "object", "properties": {"text": {"type": "string"}}},
            "safety": {"allow_pii": False, "disallowed_categories": ["toxic", "spam"]},
        }
    )
    labels = table(spark, sf_dir, "labels")
    flags = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").alias("category"))
    return policy_filter(table(spark, sf_dir, "documents").select("doc_id", "lang"), flags, plan.disallowed_categories, "doc_id")


_POLICY_SQL = """
SELECT doc_id, lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
"""

QUERIES: dict[str, Entry] = {
    "issue_profile": (issues, _ISSUES_SQL),
    "chunk_overlap": (overlap, _OVERLAP_SQL),
    "chunk_pairs": (pairs, _PAIRS_SQL),
    "axis_coverage": (coverage, _COVERAGE_SQL),
    "batch_targets": (targets, _ALL_SQL),
    "batch_targets_of_chunks": (targets_of_chunks, _CHUNKS_SQL),
    "batch_targets_each": (targets_by_batch, _TARGETS_SQL),
    "source_repeats": (repeats, _REPEATS_SQL),
    "policy_filter": (policy, _POLICY_SQL),
}
