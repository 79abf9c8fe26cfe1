"""Files written from the tables and read back: scans, sinks, run artifacts, arriving chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate import Plan
from rowgate.operators import merge_inputs, merge_rows, number_rows, row_batches, typed_projection
from rowgate.session import staging_path
from rowgate.sinks import (
    code_file_table,
    json_lines_to_columnar,
    write_code_files,
    write_columnar,
    write_json_lines,
    write_rows,
    write_run_artifacts,
)
from rowgate.sources import read_json_array, read_json_lines, read_rows, rows_from_table
from rowgate.streaming import merge_arrivals

from .checks import DOCUMENT_PLAN
from .common import Entry, joined, table
from .merging import TEXT_PLAN, _MERGED
from .scoring import GATE, gated_documents


def documents_as_rows(spark, sf_dir):
    return rows_from_table(table(spark, sf_dir, "documents"), "doc_id")


def scan_jsonl(spark, sf_dir):
    """Two inputs in order, with blank and broken lines between the rows."""
    documents = staging_path(spark, "documents") + ".jsonl"
    write_json_lines(documents_as_rows(spark, sf_dir), documents, ordered=True)
    events = staging_path(spark, "events") + ".jsonl"
    lines = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit("\n  \n"), F.col("props"), F.lit(" x"))).otherwise(
        F.concat(F.lit("  "), F.col("props"))
    )
    table(spark, sf_dir, "events").orderBy("event_id").select(lines.alias("value")).write.text(events)
    rows = read_json_lines(spark, [documents, events])
    # the rank of every line in the order of the inputs, and what it holds
    shown = F.when(F.col("input_ord") == 0, F.try_variant_get("v", "$.text", "string")).otherwise(F.col("raw"))
    lines = rows.select("seq", "input_ord", F.col("v").isNull().alias("broken"), shown.alias("content"))
    ranked = number_rows(lines, into="line")
    of_input = ranked.groupBy("input_ord").agg(F.min("line").alias("first"))
    placed = ranked.join(F.broadcast(of_input), "input_ord")  # one row per input
    return placed.select("input_ord", (F.col("line") - F.col("first")).alias("line"), "broken", "content")


_SCAN_SQL = """
WITH e AS (
  SELECT event_id, 0 AS part, props AS content, false AS broken FROM events
  UNION ALL SELECT event_id, 1, props || ' x', true FROM events WHERE event_id % 9 = 0)
SELECT 0 AS input_ord, row_number() OVER (ORDER BY doc_id) - 1 AS line, false AS broken, text AS content FROM documents
UNION ALL
SELECT 1, row_number() OVER (ORDER BY event_id, part) - 1, broken, content FROM e
"""


def scan_json_array(spark, sf_dir):
    """Files that hold one array of up to 500 documents each."""
    batched = row_batches(documents_as_rows(spark, sf_dir).drop("v"), 500)
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda r: r["raw"])
    arrays = batched.groupBy("batch_id").agg(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("]")).alias("value"))
    folder = staging_path(spark, "arrays")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    rows = read_json_array(spark, folder)
    return rows.select(
        F.try_variant_get("v", "$.doc_id", "bigint").alias("doc_id"),
        F.get_json_object("raw", "$.text").alias("text"),
        "input_ord",
    )


def split_json_array(spark, sf_dir):
    """Arrays of up to 10,000 documents on one line each, read by ranges of 256 KB."""
    batched = row_batches(documents_as_rows(spark, sf_dir).drop("v"), 10_000)
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda r: r["raw"])
    arrays = batched.groupBy("batch_id").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("value"))
    folder = staging_path(spark, "arrays")
    arrays.select("value", F.format_string("%09d", "batch_id").alias("part")).write.partitionBy("part").text(folder)
    ranked = number_rows(read_json_array(spark, folder, range_bytes=1 << 18), into="place")
    return ranked.select(
        "place", F.try_variant_get("v", "$.doc_id", "bigint").alias("doc_id"), F.get_json_object("raw", "$.text").alias("text")
    )


_SPLIT_ARRAY_SQL = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id, text FROM documents
"""


def jsonl_roundtrip(spark, sf_dir):
    path = write_rows(documents_as_rows(spark, sf_dir), staging_path(spark, "documents") + ".jsonl", "jsonl")
    return typed_projection(read_json_lines(spark, path, "failfast"), DOCUMENT_PLAN, keep=())


def format_dispatch(spark, sf_dir):
    """Documents written in every named format but code, and read back by what the folder holds."""
    rows, found = documents_as_rows(spark, sf_dir), []
    for fmt in ("json", "jsonl", "parquet", "huggingface", "HF"):
        path = write_rows(rows, staging_path(spark, "written"), fmt, DOCUMENT_PLAN, merged=True)
        back = typed_projection(read_rows(spark, path, "failfast"), DOCUMENT_PLAN, keep=())
        found.append(back.select(F.lit(fmt).alias("fmt"), "doc_id", "lang", "n_chars", "text"))
    return reduce(DataFrame.unionByName, found)


_DISPATCH_SQL = """
SELECT fmt, doc_id, lang, n_chars, text FROM documents, (VALUES ('json'), ('jsonl'), ('parquet'), ('huggingface'), ('HF')) v(fmt)
"""

_DOCUMENTS_SQL = "SELECT doc_id, lang, n_chars, text FROM documents"


def columnar_roundtrip(spark, sf_dir):
    rows = documents_as_rows(spark, sf_dir)
    lines = write_json_lines(rows, staging_path(spark, "documents") + ".jsonl")
    converted = json_lines_to_columnar(spark, lines, staging_path(spark, "converted"), DOCUMENT_PLAN)
    direct = write_columnar(rows, staging_path(spark, "direct"), DOCUMENT_PLAN)
    return spark.read.parquet(converted).withColumn("via", F.lit("lines")).unionByName(
        spark.read.parquet(direct).withColumn("via", F.lit("rows"))
    )


_COLUMNAR_SQL = """
SELECT doc_id, lang, n_chars, text, via FROM documents, (VALUES ('lines'), ('rows')) v(via)
"""

HTML_PLAN = Plan(
    "pages",
    "pages",
    {
        "type": "object",
        "properties": {"html": {"type": "string", "contentMediaType": "text/x-code", "x-language": "html"}},
    },
)


def code_files(spark, sf_dir):
    rows = rows_from_table(table(spark, sf_dir, "pages"), "page_id", ["html", "url"])
    return code_file_table(rows, HTML_PLAN).select(F.col("seq").alias("page_id"), "file_name", "content")


_CODE_FILES_SQL = """
SELECT page_id, 'sample_' || lpad((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR, 5, '0') || '.html' AS file_name,
       html AS content
FROM pages
"""


def merge_roundtrip(spark, sf_dir):
    """Merge chunk files, write the artifacts of the run, and read its accepted rows."""
    documents = table(spark, sf_dir, "documents").withColumn("chunk", F.col("doc_id") % 3)
    rows = rows_from_table(documents, ["chunk", "doc_id"], ["text"])
    merged = merge_rows(rows, TEXT_PLAN, stage_checked=True)
    paths = write_run_artifacts(merged, staging_path(spark, "merged"), TEXT_PLAN)
    accepted = read_rows(spark, paths["artifacts_dir"])
    rejected = read_json_lines(spark, paths["rejected_jsonl"])
    return accepted.select(
        F.lit("accepted").alias("file"), F.try_variant_get("v", "$.text", "string").alias("text"), F.lit("").alias("issues")
    ).unionByName(
        rejected.select(
            F.lit("rejected").alias("file"),
            F.try_variant_get("v", "$.sample.text", "string").alias("text"),
            F.array_join(F.try_variant_get("v", "$.issues", "array<string>"), "; ").alias("issues"),
        )
    )


_ROUNDTRIP_SQL = _MERGED + """
SELECT case status when 'accepted' then 'accepted' else 'rejected' end AS file, text,
       case status when 'duplicate' then 'duplicate_exact' else issues end AS issues
FROM marked
"""


def _chunk_files(spark, sf_dir):
    """One folder of JSON lines per chunk, written in one job."""
    documents = table(spark, sf_dir, "documents").withColumn("chunk", F.col("doc_id") % 3)
    folder = staging_path(spark, "chunks")
    documents.select(F.to_json(F.struct("text")).alias("value"), "chunk").write.partitionBy("chunk").text(folder)
    return folder


def merge_files(spark, sf_dir):
    folder = _chunk_files(spark, sf_dir)
    merged = merge_inputs(spark, [f"{folder}/chunk={i}/*.txt" for i in range(3)], TEXT_PLAN)
    return merged.select("input_ord", F.get_json_object("raw", "$.text").alias("text"), "status", joined())


_FILES_SQL = _MERGED + """
SELECT cast(chunk AS INTEGER) AS input_ord, text, status,
       case status when 'duplicate' then 'duplicate_exact' else issues end AS issues
FROM marked
"""


def merge_many_files(spark, sf_dir):
    """Four hundred chunk files, named one by one and merged in that order; the last is named first too."""
    documents = table(spark, sf_dir, "documents")
    folder = staging_path(spark, "many")
    line = F.to_json(F.struct("text"))
    chunks = documents.select((F.col("doc_id") % 400).alias("chunk"), "doc_id", line.alias("value"))
    chunks.repartition("chunk").sortWithinPartitions("chunk", "doc_id").select("chunk", "value").write.partitionBy("chunk").text(folder)
    present = sorted(r["chunk"] for r in chunks.select("chunk").distinct().collect())  # 400 at most
    inputs = [f"{folder}/chunk={chunk}" for chunk in present]
    merged = merge_inputs(spark, [inputs[-1], *inputs], TEXT_PLAN, fmt="jsonl")
    return merged.select(
        F.get_json_object("raw", "$.text").alias("text"), "input_ord", "status", joined()
    )


_MANY_SQL = """
WITH d AS (SELECT doc_id, text, doc_id % 400 AS chunk FROM documents),
places AS (SELECT chunk, row_number() OVER (ORDER BY chunk) AS input_ord FROM (SELECT DISTINCT chunk FROM d)),
named AS (
  SELECT text, input_ord, doc_id FROM d JOIN places USING (chunk)
  UNION ALL SELECT text, 0, doc_id FROM d WHERE chunk = (SELECT max(chunk) FROM d)),
checked AS (
  SELECT *, concat_ws('; ',
    case when length(text) < 30 then '$.text: string too short (' || length(text) || ' < 30)' end,
    case when length(text) > 8000 then '$.text: string too long (' || length(text) || ' > 8000)' end) AS issues
  FROM named),
marked AS (
  SELECT *, case when issues <> '' then 'invalid'
    when row_number() OVER (PARTITION BY issues <> '', text ORDER BY input_ord, doc_id) = 1 then 'accepted'
    else 'duplicate' end AS status
  FROM checked)
SELECT text, CAST(input_ord AS INTEGER) AS input_ord, status, case status when 'duplicate' then 'duplicate_exact' else issues end AS issues
FROM marked
"""


def incremental_merge(spark, sf_dir):
    """The same files one after another, each merged against the keys accepted before."""
    folder, base = _chunk_files(spark, sf_dir), staging_path(spark, "arrivals")
    query = merge_arrivals(
        spark, f"{folder}/*/*.txt", f"{base}/state", f"{base}/output", f"{base}/checkpoint", TEXT_PLAN, files_per_batch=1
    )
    query.awaitTermination()
    merged = spark.read.parquet(f"{base}/output")
    return merged.select(F.get_json_object("raw", "$.text").alias("text"), "status", joined())


# which of several copies comes first depends on the order of arrival; their texts are equal
_ARRIVALS_SQL = _MERGED + """
SELECT text, status, case status when 'duplicate' then 'duplicate_exact' else issues end AS issues FROM marked
"""

def code_files_roundtrip(spark, sf_dir):
    """Write one file per page, and read the files back."""
    pages = table(spark, sf_dir, "pages")
    folder = write_code_files(rows_from_table(pages, "page_id", ["html"]), staging_path(spark, "code"), HTML_PLAN)
    files = spark.read.text(f"{folder}/*.html", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1)
    return files.select(name.alias("file_name"), F.col("value").alias("content"))


_CODE_BACK_SQL = """
SELECT 'sample_' || lpad((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR, 5, '0') || '.html' AS file_name, html AS content FROM pages
"""


def gate_artifacts(spark, sf_dir):
    """Gate the documents, write the run's artifacts, and read metrics and rows back."""
    paths = write_run_artifacts(gated_documents(spark, sf_dir), staging_path(spark, "gated"), TEXT_PLAN)
    metrics = spark.read.text(paths["metrics_json"], wholetext=True).select(
        F.lit("metrics").alias("file"), F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "n")
    )
    rows = [
        read_json_lines(spark, paths[f"{file}_jsonl"]).agg(F.count("*").alias("n")).select(F.lit(file).alias("file"), F.lit("rows").alias("name"), "n")
        for file in ("accepted", "rejected")
    ]
    return metrics.unionByName(rows[0]).unionByName(rows[1])


def gate_files(spark, sf_dir):
    """What the files of the same run hold: the accepted rows, and the rejects with their issues and scores."""
    paths = write_run_artifacts(gated_documents(spark, sf_dir), staging_path(spark, "gated"), TEXT_PLAN)
    shown = [
        read_json_lines(spark, paths[f"{file}_jsonl"], "failfast").select(
            F.lit(file).alias("file"),
            F.try_variant_get("v", f"{root}.text", "string").alias("text"),
            F.array_join(F.try_variant_get("v", "$.issues", "array<string>"), "; ").alias("issues"),
            F.try_variant_get("v", "$.score", "double").alias("score"),
        )
        for file, root in (("accepted", "$"), ("rejected", "$.sample"))
    ]
    return shown[0].unionByName(shown[1])


_GATED_SQL = GATE + """
, counted AS (
  SELECT count(*) AS raw_sample_count, count(*) FILTER (status = 'accepted') AS valid_count,
    count(*) FILTER (status <> 'accepted') AS rejected_count, count(*) FILTER (status = 'duplicate') AS duplicate_count,
    count(DISTINCT batch_id) FILTER (batch_error IS NOT NULL) AS validation_error_batches
  FROM gated)
SELECT 'metrics' AS file, name, n FROM (UNPIVOT counted ON COLUMNS(*) INTO NAME name VALUE n)
UNION ALL SELECT 'accepted', 'rows', valid_count FROM counted
UNION ALL SELECT 'rejected', 'rows', rejected_count FROM counted
"""

_GATED_FILES_SQL = GATE + """
SELECT CASE status WHEN 'accepted' THEN 'accepted' ELSE 'rejected' END AS file, text,
  CASE WHEN status <> 'accepted' THEN issues END AS issues, CASE WHEN status <> 'accepted' THEN score END AS score
FROM gated JOIN documents USING (doc_id)
"""

QUERIES: dict[str, Entry] = {
    "scan_jsonl": (scan_jsonl, _SCAN_SQL),
    "scan_json_array": (scan_json_array, "SELECT doc_id, text, 0 AS input_ord FROM documents"),
    "jsonl_roundtrip": (jsonl_roundtrip, _DOCUMENTS_SQL),
    "format_dispatch": (format_dispatch, _DISPATCH_SQL),
    "columnar_roundtrip": (columnar_roundtrip, _COLUMNAR_SQL),
    "code_file_table": (code_files, _CODE_FILES_SQL),
    "code_files_roundtrip": (code_files_roundtrip, _CODE_BACK_SQL),
    "gate_artifacts": (gate_artifacts, _GATED_SQL),
    "gate_files": (gate_files, _GATED_FILES_SQL),
    "merge_roundtrip": (merge_roundtrip, _ROUNDTRIP_SQL),
    "merge_files": (merge_files, _FILES_SQL),
    "merge_many_files": (merge_many_files, _MANY_SQL),
    "split_json_array": (split_json_array, _SPLIT_ARRAY_SQL),
    "incremental_merge": (incremental_merge, _ARRIVALS_SQL),
}
