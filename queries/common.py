"""Helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
Entry = tuple[Query, str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(column: str = "issues") -> Column:
    return F.array_join(column, "; ").alias("issues")


def json_rows(df: DataFrame, order: str, raw: Column, *keep: str) -> DataFrame:
    """JSON rows from a text column built by the query."""
    from rowgate.functions.json_text import with_parsed

    rows = df.select(F.col(order).alias("seq"), *keep, raw.alias("raw"))
    return with_parsed(rows, "raw", "v")
