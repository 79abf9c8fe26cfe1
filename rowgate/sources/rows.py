"""Rows of JSON from files, and rows from tables.

Every reader returns ``seq`` (order), ``input_ord``, ``raw`` (JSON text) and ``v`` (VARIANT,
NULL where the text is not valid JSON).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_text import parse_json, with_parsed
from ..functions.text import quote_column, strip
from .arrays import RANGE_BYTES, read_array_elements, read_array_texts, reads_ranges
from .inputs import input_groups
from .order import file_order, in_input, is_file_order, order_key

BAD_JSON = "bad_json"


def _finish(rows: DataFrame, mode: str) -> DataFrame:
    if mode not in ("quarantine", "failfast"):
        raise ValueError("mode must be 'quarantine' or 'failfast'")
    if mode == "failfast":
        problem = F.raise_error(F.concat(F.lit("not valid JSON: "), F.left("raw", F.lit(200))))
        rows = rows.withColumn("v", F.when(F.col("v").isNull(), problem.cast("variant")).otherwise(F.col("v")))
    return rows.select("seq", "input_ord", "raw", "v")


def read_json_lines(
    spark: SparkSession, inputs: str | Sequence[str], mode: str = "quarantine", numbers: Sequence[int] | None = None
) -> DataFrame:
    """One JSON value per line, blank lines skipped, inputs in the order given.

    ``mode="quarantine"`` keeps a bad line with ``v`` NULL, ``"failfast"`` raises on it. All inputs are one scan; which
    of them a line belongs to comes from its file's path, so nothing is joined and no text moves. A file that several
    inputs name counts for each of them. The place of a line depends on how files are split into tasks; its rank does not.
    ``numbers`` are the inputs' places among others, if not 0, 1, 2 ...
    """
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    scans = []
    for group in input_groups(spark, inputs, numbers):
        lines = group.scan(spark.read.format("text"), strip(F.col("value")).alias("raw"), F.monotonically_increasing_id())
        scans.append(lines.where("raw <> ''"))
    return _finish(with_parsed(reduce(DataFrame.unionAll, scans), "raw", "v"), mode)


def read_json_array(
    spark: SparkSession,
    inputs: str | Sequence[str],
    mode: str = "failfast",
    numbers: Sequence[int] | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Files that each hold one JSON array; every element is a row, as it is written.

    Files are read by ranges of ``range_bytes``, so a file of any size is read by many tasks (packed files, and file systems that
    only Spark can read, by one task a file). Text that is not one array is an error. Inputs and ``numbers`` as
    in ``read_json_lines``.
    """
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    found = []
    for group in input_groups(spark, inputs, numbers):
        ranges = all(reads_ranges(spark, path) for path in {p.partition(":")[0]: p for p in group.paths}.values())
        found.append(read_array_elements(spark, group, range_bytes) if ranges else read_array_texts(spark, group))
    elements = reduce(DataFrame.unionAll, found)
    return _finish(with_parsed(elements.withColumn("input_ord", F.col("seq.input")), "raw", "v"), mode)


def json_elements(raw: str, value: Column) -> Column:
    """The elements of a JSON array as structs ``(raw, v)``.

    Text elements lose their quotes in ``from_json``, so scalars are printed from ``v``;
    objects and arrays keep their own text, in which ``1.0`` stays ``1.0``.
    """
    texts = F.from_json(F.col(raw), T.ArrayType(T.StringType()), {"maxStringLen": str(2**31 - 1)})
    values = value.cast("array<variant>")
    return F.transform(
        F.arrays_zip(texts.alias("t"), values.alias("v")),
        lambda e: F.struct(
            F.when(F.schema_of_variant(e["v"]).rlike("^(OBJECT|ARRAY)<"), e["t"])
            .otherwise(F.to_json(e["v"]))
            .alias("raw"),
            e["v"].alias("v"),
        ),
    )


def rows_from_table(
    df: DataFrame,
    order: str | Sequence[str],
    columns: Sequence[str] | None = None,
    null_as: str = "absent",
    input_ord: int = 0,
) -> DataFrame:
    """Rows of JSON from a typed table. ``order`` names columns that are unique together.

    Dates and timestamps become text. A NULL is left out, or with ``null_as="null"`` kept as
    a JSON null.
    """
    order = [order] if isinstance(order, str) else list(order)
    fields = []
    for name in columns or df.columns:
        column = F.col(quote_column(name))
        if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        fields.append(column.alias(name))
    keep_nulls = {"ignoreNullFields": "false" if null_as == "null" else "true"}
    return df.select(
        order_key(df, *order).alias("seq"),
        F.lit(input_ord).alias("input_ord"),
        F.to_json(F.struct(*fields), keep_nulls).alias("raw"),
    ).withColumn("v", parse_json(F.col("raw")))


def read_columnar(spark: SparkSession, path: str, null_as: str = "absent") -> DataFrame:
    """Rows of a parquet dataset, ordered by file name and row number in the file."""
    table = spark.read.parquet(path)
    placed = table.select("*", file_order(F.lit(0), F.col("_metadata.row_index")).alias("__seq"))
    return rows_from_table(placed, "__seq", table.columns, null_as)


FORMATS = ("jsonl", "json", "parquet", "run")


def input_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """The format of an input and the path to read.

    A folder is an earlier run if it holds ``accepted.jsonl``, parquet if it holds parquet files, else JSON
    lines; a file is judged by its suffix. Patterns are judged by their suffix too.
    """
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(c in path for c in "*?[{") or not system.exists(made) or not system.getFileStatus(made).isDirectory():
        return ("json" if path.endswith(".json") else "parquet" if path.endswith(".parquet") else "jsonl"), path
    names = [status.getPath().getName() for status in system.listStatus(made)]
    if "accepted.jsonl" in names:
        return "jsonl", f"{path.rstrip('/')}/accepted.jsonl"
    # a dataset in partitions has folders like day=1 and no file of its own
    data = [n for n in names if not n.startswith(("_", "."))]
    if path.rstrip("/").endswith(".parquet") or any(n.endswith(".parquet") or "=" in n for n in data):
        return "parquet", path
    return "jsonl", path


def _formats(spark: SparkSession, inputs: Sequence[str]) -> list[tuple[str, str]]:
    """Formats of many inputs; what a path is takes a call or two, so many are asked at a time."""
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(lambda path: input_format(spark, path), inputs))


def union_rows(*inputs: DataFrame) -> DataFrame:
    """All rows of the inputs, in argument order; ``input_ord`` counts the inputs."""
    numbered = [df.withColumn("input_ord", F.lit(number)) for number, df in enumerate(inputs)]
    if any(is_file_order(df.schema["seq"].dataType) for df in inputs):
        ordered = [df.withColumn("seq", in_input(df, number)) for number, df in enumerate(numbered)]
    else:
        ordered = [df.withColumn("seq", order_key(df, "input_ord", "seq")) for df in numbered]
    return reduce(DataFrame.unionByName, ordered)


def read_rows(
    spark: SparkSession, inputs: str | Sequence[str], mode: str = "quarantine", fmt: str | None = None
) -> DataFrame:
    """Read inputs of any known format, in the order given.

    ``fmt`` (``jsonl``, ``json``, ``parquet`` or ``run``) says what all of them are; without it each is
    looked at (see ``input_format``).
    """
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    if fmt is not None and fmt not in FORMATS:
        raise ValueError(f"unknown input format {fmt!r}; known: {list(FORMATS)}")
    if fmt == "run":
        found = [("jsonl", f"{path.rstrip('/')}/accepted.jsonl") for path in inputs]
    else:
        found = [(fmt, path) for path in inputs] if fmt else _formats(spark, inputs)
    parts = []
    for kind, reader in (("jsonl", read_json_lines), ("json", read_json_array)):
        numbers = [number for number, (named, _) in enumerate(found) if named == kind]
        if numbers:  # one scan for all inputs of a kind; their rows know the inputs' places
            parts.append(reader(spark, [found[n][1] for n in numbers], mode, numbers))
    for number, (kind, path) in enumerate(found):
        if kind == "parquet":
            rows = read_columnar(spark, path).withColumn("input_ord", F.lit(number))
            parts.append(rows.withColumn("seq", in_input(rows, number)))
    return reduce(DataFrame.unionByName, parts)
