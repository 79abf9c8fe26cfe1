"""A total order over the rows of many inputs and files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One type for rows of all kinds of files: input, file, split of the file, row in it. Compared from
# left to right, so it needs no table of files and no limit on their number or size.
ORDER = T.StructType(
    [
        T.StructField("input", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)


def file_order(block: Column, row: Column, input_number: int = 0) -> Column:
    """The order of a row of a file that is scanned right here."""
    return F.struct(
        F.lit(input_number).alias("input"),
        F.col("_metadata.file_path").alias("file"),
        block.cast("bigint").alias("block"),
        row.cast("bigint").alias("row"),
    )


def is_file_order(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.simpleString() == ORDER.simpleString()


def in_input(rows: DataFrame, number: int) -> Column:
    """``seq`` as the order of the ``number``-th input among several."""
    kind = rows.schema["seq"].dataType
    if is_file_order(kind):
        file, block, row = (F.col(f"seq.{name}") for name in ("file", "block", "row"))
    elif isinstance(kind, T.IntegralType):
        file, block, row = F.lit(""), F.lit(0), F.col("seq")
    else:
        raise ValueError(f"rows ordered by {kind.simpleString()} cannot be put in order with rows of files")
    return F.struct(
        F.lit(number).alias("input"), file.alias("file"), block.cast("bigint").alias("block"), row.cast("bigint").alias("row")
    )


def order_key(df: DataFrame, *columns: str) -> Column:
    """An order key of one or more columns; earlier columns weigh more.

    One integer column stays as it is. Two become one decimal, which Spark can minimise in
    a hash aggregate. Anything else becomes a struct.
    """
    types = [df.schema[name].dataType for name in columns]
    if len(columns) == 1:
        return F.col(columns[0])
    if len(columns) == 2 and all(isinstance(t, T.IntegralType) for t in types):
        high = F.col(columns[0]).cast("decimal(19,0)") * F.lit(Decimal(2**64)).cast("decimal(20,0)")
        return (high + F.col(columns[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*[F.col(name) for name in columns])
