"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)


# DuckDB names of the Spark types that the queries return
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def type_difference(df, connection, sql: str) -> str | None:
    described = {d[0]: str(d[1]) for d in connection.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    found = {name: DUCK_TYPES.get(kind, kind) for name, kind in df.dtypes}
    return None if found == described else f"types {found} and {described}"


def duck_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(_cell(row[i]) for i in at) for row in result.fetchall()), key=repr)


def difference(df, connection, sql: str) -> str | None:
    """None if the rows are equal, else a short description of the first difference."""
    wrong_types = type_difference(df, connection, sql)
    if wrong_types:
        return wrong_types
    (names, found), (other, expected) = spark_rows(df), duck_rows(connection, sql)
    if names != other:
        return f"columns {names} and {other}"
    if len(found) != len(expected):
        return f"{len(found)} rows and {len(expected)}"
    for one, two in zip(found, expected):
        if one != two:
            return f"{repr(one)[:600]}\n and \n{repr(two)[:600]}"
    return None
