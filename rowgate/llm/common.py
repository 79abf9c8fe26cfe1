"""What several operators of this subpackage need."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Rows per Arrow batch: some texts have a hundred thousand characters, so batches are kept short.
BATCH_ROWS = 400

# Space and the controls from tab to carriage return, which bytes.split() takes as separators too.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_shipped: set[str] = set()


def prepared(spark: SparkSession) -> SparkSession:
    """Set the size of Arrow batches, and send this package to the Python workers once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package, made = Path(__file__).resolve().parents[1], tempfile.mkdtemp()
        atexit.register(shutil.rmtree, made, ignore_errors=True)  # the driver serves the archive until it ends
        copy = Path(made, "package", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{made}/{package.name}", "zip", copy.parent))
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark schema; on the driver, as Spark parses it."""
    return to_arrow_schema(_parse_datatype_string(schema))


def over_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], list[list]], schema: str
) -> DataFrame:
    """Map Arrow batches to columns: ``work`` returns one list per column of ``schema``."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return df.mapInArrow(run, schema)
