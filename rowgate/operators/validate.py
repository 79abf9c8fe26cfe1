"""Check rows against a plan and split them into valid rows and rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.row_checks import no_issues, with_schema_issues
from ..functions.text import quote_column
from ..functions.values import Bindings, VariantValue, case
from ..plans import Plan, Profile, rules_of
from ..sources.rows import BAD_JSON


def validate_rows(
    rows: DataFrame,
    plan: Plan | dict | None,
    *,
    columns: Sequence[str] | None = None,
    profiles: dict[str, Profile] | None = None,
    null_as: str = "absent",
) -> DataFrame:
    """Add ``issues``: schema issues first, then those of the rules of the plan's profile.

    ``rows`` are JSON rows with ``v``, or typed rows if ``columns`` are named. A plan may be
    a bare schema; without a plan only broken JSON is an issue.
    """
    value = None if columns is not None else "v"
    if plan is None:
        checked = rows.withColumn("issues", no_issues())
    else:
        schema = plan.row_schema if isinstance(plan, Plan) else plan
        checked = with_schema_issues(rows, schema, value=value, columns=columns, null_as=null_as)
    rules = rules_of(plan, profiles) if isinstance(plan, Plan) else ()
    if rules:
        found = F.concat(F.col("issues"), *[rule(rows, value) for rule in rules])
        checked = checked.withColumn("issues", found)
    if value is not None:
        broken = F.col("v").isNull()
        checked = checked.withColumn("issues", F.when(broken, F.array(F.lit(BAD_JSON))).otherwise(F.col("issues")))
    return checked


def is_valid() -> Column:
    return F.size("issues") == 0


def split_rejects(checked: DataFrame) -> DataFrame:
    """Add ``status`` (``valid`` or ``rejected``) and ``score``, 0.0 for rejects."""
    return checked.withColumns(
        {
            "status": F.when(is_valid(), "valid").otherwise("rejected"),
            "score": F.when(~is_valid(), 0.0),
        }
    )


def _projected(value: VariantValue, rules: dict) -> str:
    kind, items, fields = rules.get("type"), rules.get("items"), rules.get("properties")
    if kind == "string":
        return case((value.is_string(), value.string()))
    if kind == "integer":
        return case((value.is_integer(), value.get("bigint")))
    if kind == "number":
        return case((value.is_number(), value.get("double")))
    if kind == "boolean":
        return case((value.is_boolean(), value.boolean()))
    if kind == "object" and fields:
        inner = [f"{_projected(value.child(name)[1], sub)} AS {quote_column(name)}" for name, sub in fields.items()]
        return case((value.is_object(), f"struct({', '.join(inner)})"))
    if kind == "array" and isinstance(items, dict):
        return case((value.is_array(), value.each(lambda item, _: _projected(item, items))))
    return value.x


def typed_projection(rows: DataFrame, plan: Plan, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """JSON rows as typed columns of the plan; a value of another type becomes NULL.

    Columns are sorted by name, or in field order for plans of the older form. A field
    without a declared shape stays VARIANT.
    """
    bindings, properties = Bindings("field"), plan.row_schema["properties"]
    root = VariantValue("v", bindings)
    found = {name: root.child(name)[1] for name in plan.field_names}
    fields = [f"{_projected(found[name], properties[name])} AS {quote_column(name)}" for name in found]
    return bindings.add_to(rows).selectExpr(*keep, *fields)


def _exact(column: Column, kind: T.DataType) -> Column:
    """The column in a form whose JSON text tells all its values apart, and equal ones not."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return column.cast("string")  # to the microsecond, which JSON text is not
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_exact(e["key"], kind.keyType).alias("k"), _exact(e["value"], kind.valueType).alias("v"))
        entries = F.transform(F.map_entries(column), entry)
        # by the key's text, as values may have no order
        return F.array_sort(entries, lambda a, b: F.when(_text(a["k"]) < _text(b["k"]), -1).when(_text(a["k"]) > _text(b["k"]), 1).otherwise(0))
    if isinstance(kind, T.ArrayType) and _needs_care(kind.elementType):
        return F.transform(column, lambda e: _exact(e, kind.elementType))
    if isinstance(kind, T.StructType) and _needs_care(kind):
        fields = [_exact(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def _text(column: Column) -> Column:
    return F.to_json(F.struct(column.alias("x")))


def _needs_care(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _needs_care(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_needs_care(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.MapType))


def columns_as_json(columns: Sequence[str], rows: DataFrame | None = None) -> Column:
    """Typed columns as one JSON text; equal texts mean equal rows of one table.

    With ``rows``, which tell the types, timestamps count to the microsecond and the order of
    a map's entries does not count.
    """
    exact = {name: F.col(quote_column(name)) for name in columns}
    if rows is not None:
        exact = {name: _exact(column, rows.schema[name].dataType) for name, column in exact.items()}
    return F.to_json(F.struct(*[column.alias(name) for name, column in exact.items()]))


def outputs(rows: DataFrame, names: Sequence[str], prefix: str = "") -> dict[str, str]:
    """The names of result columns; an error if ``rows`` have one of them, as it would be lost."""
    named = {name: f"{prefix}{name}" for name in names}
    taken = sorted(set(named.values()) & set(rows.columns))
    if taken:
        raise ValueError(f"rows already have the columns {taken}; give another prefix for the results")
    return named
