"""Writers: JSON lines, typed parquet, code files, and the artifacts of a run."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_text import parse_json
from ..functions.text import quote_column
from ..functions.values import VariantValue
from ..operators.batches import number_rows
from ..operators.merge import merge_counts
from ..operators.validate import typed_projection
from ..operators.verdicts import gate_counts
from ..plans import Plan
from ..session import arrow_file_system, delete_folder, qualified
from ..sources.rows import read_json_lines


# Columns of a merge or gate that are no part of a row.
_NOT_ROW = ("seq", "input_ord", "raw", "v", "status", "issues", "score", "batch_id", "pos", "batch_n", "batch_error")


def with_raw(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with their JSON text: of the named columns, or of all that a merge did not add, if they are typed."""
    if "raw" in rows.columns and columns is None:
        return rows
    names = columns if columns is not None else [c for c in rows.columns if c not in _NOT_ROW]
    fields = []
    for name in names:
        column = F.col(quote_column(name))
        if isinstance(rows.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        fields.append(column.alias(name))
    return rows.withColumn("raw", F.to_json(F.struct(*fields)))


def write_json_lines(rows: DataFrame, path: str, ordered: bool = False) -> str:
    """One JSON object per line, as a folder of part files; ``ordered`` sorts by ``seq``."""
    rows = with_raw(rows)
    lines = rows.orderBy("seq") if ordered else rows
    lines.select(F.col("raw").alias("value")).write.text(path)
    return path


def write_columnar(rows: DataFrame, path: str, plan: Plan) -> str:
    """Typed columns of the plan as parquet."""
    if "v" not in rows.columns:
        rows = rows.withColumn("v", parse_json(F.col("raw")))
    typed_projection(rows, plan, keep=()).write.parquet(path)
    return path


def json_lines_to_columnar(spark: SparkSession, source: str, path: str, plan: Plan) -> str:
    """Convert JSON lines written by an earlier run to typed parquet."""
    return write_columnar(read_json_lines(spark, source, "failfast"), path, plan)


def code_file_table(rows: DataFrame, plan: Plan | None) -> DataFrame:
    """``file_name`` and ``content`` per row: the code field, or the row as JSON without one."""
    field, extension = plan.code_field if plan is not None else (None, ".txt")
    if "v" not in rows.columns:
        rows = rows.withColumn("v", parse_json(F.col("raw")))
    numbered = number_rows(rows, into="__idx")
    number = F.col("__idx").cast("string")
    stem = F.concat(F.lit("sample_"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))
    if field is None:
        name, content = F.concat(stem, F.lit(".json")), F.col("raw")
    else:
        has_field, value = VariantValue("v").child(field)
        present = F.expr(has_field)
        refused = F.raise_error(F.concat(F.lit(f"field {field} is not text in "), stem)).cast("string")
        text = F.when(F.expr(value.is_string()), F.expr(value.string())).otherwise(refused)
        name = F.concat(stem, F.when(present, extension).otherwise(".json"))
        content = F.when(present, text).otherwise(F.col("raw"))
    return numbered.select("seq", name.alias("file_name"), content.alias("content"))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file from the driver, on whatever file system Spark takes the path for."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = made.getFileSystem(spark._jsc.hadoopConfiguration()).create(made, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_code_files(rows: DataFrame, path: str, plan: Plan | None) -> str:
    """One file per row below ``path``, written by the tasks, and all rows in a manifest.

    ``path`` must be reachable from every executor. A repeated task writes the same files.
    """
    target = qualified(rows.sparkSession, path).rstrip("/")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file_name"], frame["content"]):
                system, place = arrow_file_system(f"{target}/{name}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place, compression=None) as out:
                    out.write(content.encode("utf-8"))
            yield pd.DataFrame({"files": [len(frame)]})

    files = code_file_table(rows, plan).select("file_name", "content")
    files.mapInPandas(write, "files bigint").agg(F.sum("files")).collect()
    write_json_lines(rows, f"{target}/manifest.jsonl")
    return path


FORMATS = ("json", "jsonl", "parquet", "huggingface", "hf", "code")


def write_rows(rows: DataFrame, path: str, fmt: str, plan: Plan | None = None, *, merged: bool = False) -> str:
    """Write rows in a named format; merged rows cannot be written as code files."""
    name = fmt.lower()
    if name not in FORMATS or (merged and name == "code"):
        raise ValueError(f"unknown output format {fmt!r}; known: {[f for f in FORMATS if not (merged and f == 'code')]}")
    if name in ("json", "jsonl"):
        return write_json_lines(rows, path)
    if name == "code":
        return write_code_files(rows, path, plan)
    if plan is None:
        raise ValueError("columnar output needs a plan, which names the columns and their types")
    return write_columnar(rows, path, plan)


def artifacts_dir(output_path: str) -> str:
    for suffix in (".jsonl", ".json"):
        if output_path.endswith(suffix):
            return f"{output_path[: -len(suffix)]}_artifacts"
    return f"{output_path.rstrip('/')}/_artifacts"


def _reject_record() -> Column:
    """A rejected row as one JSON object: the row, its issues and its score."""
    # text that is not JSON is kept as a JSON string
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("raw").alias("r"))), r'(?s)^\{"r":(.*)\}$', 1)
    sample = F.when(F.array_contains("issues", "bad_json"), quoted).otherwise(F.col("raw"))
    return F.concat(
        F.lit('{"sample": '), sample, F.lit(', "issues": '), F.to_json("issues"), F.lit(', "score": '),
        F.coalesce(F.col("score").cast("string"), F.lit("null")), F.lit("}"),
    )


def reject_records(classified: DataFrame) -> DataFrame:
    """Rejected rows as one JSON object each: the row, its issues and its score."""
    return classified.where("status <> 'accepted'").withColumn("raw", _reject_record())


def _place(spark: SparkSession, source: str, target: str) -> None:
    """Move a written folder to its place; where nothing was written, an empty folder takes it."""
    made = spark._jvm.org.apache.hadoop.fs.Path(source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(goal):
        raise FileExistsError(target)
    if not (system.rename(made, goal) if system.exists(made) else system.mkdirs(goal)):
        raise OSError(f"cannot write {target}")


def write_run_artifacts(
    classified: DataFrame,
    output_path: str,
    plan: Plan | None = None,
    metrics: DataFrame | None = None,
    config: dict | None = None,
    *,
    columns: list[str] | None = None,
    columnar: bool = False,
) -> dict[str, str]:
    """Write ``accepted.jsonl``, ``rejected.jsonl``, ``metrics.json`` and ``plan.json``.

    The classified rows are read once: one write deals them to both files, and the counts are observed while they pass. Rows
    of a gate get the counts of a gate. Typed rows are written as JSON: their ``columns``, or all that a merge did not add.
    ``columnar`` also writes the accepted rows as typed parquet to ``hf_dataset``, from the file of accepted rows.
    """
    if columnar and plan is None:
        raise ValueError("columnar output needs a plan, which names the columns and their types")
    spark, folder = classified.sparkSession, artifacts_dir(output_path)
    paths = {
        "artifacts_dir": folder,
        **{f"{file}_jsonl": f"{folder}/{file}.jsonl" for file in ("accepted", "rejected")},
        "metrics_json": f"{folder}/metrics.json",
    }
    rows, counts = with_raw(classified, columns), Observation()
    if metrics is None:
        aggregates = merge_counts()
        if "batch_error" in rows.columns:
            if "pos" not in rows.columns:
                raise ValueError("the rows of a gate need their place in the batch, pos")
            aggregates = gate_counts()
        rows = rows.observe(counts, *aggregates)
    accepted = F.col("status") == "accepted"
    lines = rows.select(
        F.when(accepted, F.col("raw")).otherwise(_reject_record()).alias("value"),
        F.when(accepted, "accepted").otherwise("rejected").alias("file"),
    )
    lines.write.partitionBy("file").text(f"{folder}/_rows")
    for file in ("accepted", "rejected"):
        _place(spark, f"{folder}/_rows/file={file}", paths[f"{file}_jsonl"])
    delete_folder(spark, f"{folder}/_rows")
    if columnar:
        paths["hf_dataset"] = json_lines_to_columnar(spark, paths["accepted_jsonl"], f"{folder}/hf_dataset", plan)
    found = counts.get if metrics is None else metrics.first().asDict()
    _put(spark, paths["metrics_json"], json.dumps(found, indent=2))
    if plan is not None:
        paths["plan_json"] = f"{folder}/plan.json"
        _put(spark, paths["plan_json"], plan.to_json())
    if config is not None:
        paths["config_json"] = f"{folder}/config.json"
        _put(spark, paths["config_json"], json.dumps(config, indent=2))
    return paths
