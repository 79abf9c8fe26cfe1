"""What a row check may ask about a value, for VARIANT values and for typed columns.

Answers are SQL text, which one call turns into an expression however wide a schema is, or a
plain ``True`` / ``False`` where they are known before the job runs. ``both``, ``either`` and
``negate`` fold those away.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from itertools import count
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import python_float, python_string, quote_column, sql_text

Answer = str | bool

# The schema type names and the names Python gives to parsed JSON values.
SCHEMA_TYPES = ("string", "integer", "number", "boolean", "object", "array", "null")
PYTHON_NAMES = {
    "STRING": "str",
    "BIGINT": "int",
    "DOUBLE": "float",
    "DECIMAL": "float",
    "BOOLEAN": "bool",
    "VOID": "NoneType",
    "OBJECT": "dict",
    "ARRAY": "list",
}

_lambda_names = count()


def both(left: Answer, right: Answer) -> Answer:
    if left is False or right is False:
        return False
    if left is True:
        return right
    return left if right is True else f"({left} AND {right})"


def either(left: Answer, right: Answer) -> Answer:
    return negate(both(negate(left), negate(right))) if isinstance(left, bool) or isinstance(right, bool) else (
        f"({left} OR {right})"
    )


def negate(answer: Answer) -> Answer:
    return (not answer) if isinstance(answer, bool) else f"(NOT {answer})"


def as_sql(answer: Answer) -> str:
    return str(answer).upper() if isinstance(answer, bool) else answer


def case(*cases: tuple[Answer, str], otherwise: str = "NULL") -> str:
    """CASE WHEN without the cases whose answer is known."""
    parts = []
    for answer, result in cases:
        if answer is False:
            continue
        if answer is True:
            otherwise = result
            break
        parts.append(f"WHEN {answer} THEN {result}")
    return f"CASE {' '.join(parts)} ELSE {otherwise} END" if parts else otherwise


def _one_of(value: str, choices: list, show: Callable[[Any], str]) -> str:
    return f"({value} IN ({', '.join(map(show, choices))}))" if choices else "FALSE"


class _Choices:
    """The values of an enum by the kind of value they can equal, as in Python."""

    def __init__(self, choices: list):
        numbers = [c for c in choices if isinstance(c, (int, float))]
        self.strings = [c for c in choices if isinstance(c, str)]
        self.numbers = [float(n) for n in numbers]
        self.whole = [int(n) for n in numbers if float(n).is_integer() and abs(n) < 2**63]
        self.has_null = str(None in choices).upper()
        self.nested = [json.dumps(c, ensure_ascii=False) for c in choices if isinstance(c, (list, dict))]

    def has_string(self, value: str) -> str:
        return _one_of(value, self.strings, sql_text)

    def has_whole(self, value: str) -> str:
        return _one_of(value, self.whole, lambda n: f"{n}L")

    def has_number(self, value: str) -> str:
        return _one_of(value, self.numbers, lambda n: f"{n!r}D")

    def has_nested(self, json_text: str) -> str:
        return _one_of(json_text, self.nested, lambda text: f"to_json(parse_json({sql_text(text)}))")


class Bindings:
    """Intermediate columns, level by level, so that no expression is computed twice.

    A column of one level may use those of the levels below it. Catalyst keeps such
    projections apart when an expression is costly and used more than once.
    """

    def __init__(self, prefix: str):
        self.prefix, self.size = prefix, 0
        self.levels: list[dict[str, str]] = []

    def bind(self, expression: str, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"__{self.prefix}_{self.size}"
        self.size += 1
        self.levels[level][name] = expression
        return name

    def add_to(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.selectExpr("*", *[f"{expression} AS {name}" for name, expression in level.items()])
        return df

    def drop_from(self, df: DataFrame) -> DataFrame:
        return df.drop(*[name for level in self.levels for name in level])


class VariantValue:
    """A VARIANT expression ``x`` (NULL = absent) and the text of its type, ``kind``.

    ``settled`` names the schema type that a test has already established.
    """

    def __init__(self, x: str, bindings: Bindings | None = None, level: int = 0, kind: str | None = None):
        self.bindings, self.level, self.settled = bindings, level, None
        self.x = x if bindings is None else bindings.bind(x, level)
        kind = f"schema_of_variant({self.x})" if kind is None else kind
        self.kind = kind if bindings is None else bindings.bind(kind, level + 1)

    def settle(self, schema_type: str) -> VariantValue:
        value = copy.copy(self)
        value.settled = schema_type
        return value

    def _is(self, answer: str, *settled_by: str, open_for: tuple[str, ...] = ()) -> Answer:
        if self.settled is None or self.settled in open_for:
            return answer
        return self.settled in settled_by

    def get(self, kind: str) -> str:
        return f"try_variant_get({self.x}, '$', '{kind}')"

    def _is_big_integer(self) -> str:
        return f"rlike({self.kind}, '^DECIMAL[(](19|[23][0-9]),0[)]')"

    def is_string(self) -> Answer:
        return self._is(f"({self.kind} = 'STRING')", "string")

    def is_boolean(self) -> Answer:
        return self._is(f"({self.kind} = 'BOOLEAN')", "boolean", open_for=("number",))

    def is_integer(self) -> Answer:
        answer = f"({self.kind} = 'BIGINT' OR {self._is_big_integer()})"
        return self._is(answer, "integer", open_for=("number",))

    def is_number(self) -> Answer:
        answer = f"({self.kind} IN ('BIGINT', 'DOUBLE') OR startswith({self.kind}, 'DECIMAL'))"
        return self._is(answer, "integer", open_for=("number",))

    def is_array(self) -> Answer:
        return self._is(f"startswith({self.kind}, 'ARRAY<')", "array")

    def is_object(self) -> Answer:
        return self._is(f"startswith({self.kind}, 'OBJECT<')", "object")

    def is_null(self) -> Answer:
        return self._is(f"({self.kind} = 'VOID')", "null")

    def type_name(self) -> str:
        names = ", ".join(f"'{kind}', '{name}'" for kind, name in PYTHON_NAMES.items())
        named = f"try_element_at(map({names}), regexp_extract({self.kind}, '^[A-Z]+', 0))"
        return f"if({self._is_big_integer()}, 'int', {named})"

    def string(self) -> str:
        return self.get("string")

    def boolean(self) -> str:
        return self.get("boolean")

    def compare(self, sign: str, limit: float) -> str:
        inexact = f"{self.get('double')} {sign} {float(limit)!r}D"
        if isinstance(limit, int) and abs(limit) < 2**63:
            return f"if({self.kind} = 'BIGINT', {self.get('bigint')} {sign} {int(limit)}L, {inexact})"
        return f"({inexact})"

    def number_text(self) -> str:
        return case(
            (f"{self.kind} = 'BIGINT'", f"CAST({self.get('bigint')} AS STRING)"),
            (self._is_big_integer(), f"CAST({self.get('decimal(38,0)')} AS STRING)"),
            otherwise=python_float(self.get("double")),
        )

    def text(self) -> str:
        return case(
            (self.is_string(), python_string(self.string())),
            (self.is_number(), self.number_text()),
            (self.is_boolean(), f"if({self.boolean()}, 'True', 'False')"),
            (self.is_null(), "'None'"),
            otherwise=f"to_json({self.x})",
        )

    def among(self, choices: list) -> str:
        known, number = _Choices(choices), self.is_number()
        return case(
            (self.is_string(), known.has_string(self.string())),
            (both(number, f"{self.kind} = 'BIGINT'"), known.has_whole(self.get("bigint"))),
            (number, known.has_number(self.get("double"))),
            (self.is_boolean(), known.has_whole(f"CAST({self.boolean()} AS BIGINT)")),
            (self.is_null(), known.has_null),
            otherwise=known.has_nested(f"to_json({self.x})"),
        )

    def size(self) -> str:
        return f"size({self.get('array<variant>')})"

    def each(self, check: Callable[[Any, str], str], expected: Any = None) -> str:
        """``check`` on every item. Arrays that hold only the expected kind of scalar (and
        nulls) are checked as typed arrays, which saves a type test per item."""
        mixed = _transform(self.get("array<variant>"), lambda item, i: check(VariantValue(item), i))
        typed = {"string": T.StringType(), "integer": T.LongType(), "number": T.LongType()}.get(expected)
        if typed is None:
            return mixed
        kind = typed.simpleString()
        alike = _transform(self.get(f"array<{kind}>"), lambda item, i: check(TypedValue(item, typed, True), i))
        return f"if({self.kind} = 'ARRAY<{kind.upper()}>', {alike}, {mixed})"

    def child(self, name: str) -> tuple[Answer, VariantValue]:
        quote = "'" if "'" not in name else '"'
        if quote in name:  # paths have no escapes
            found = f"try_element_at({self.get('map<string,variant>')}, {sql_text(name)})"
        else:
            found = f"try_variant_get({self.x}, {sql_text(f'$[{quote}{name}{quote}]')}, 'variant')"
        value = VariantValue(found, self.bindings, self.level + 1)
        return f"({value.x} IS NOT NULL)", value

    def extra_names(self, known: list[str]) -> tuple[list[tuple[Answer, str]], str | None]:
        return [], _without(f"map_keys({self.get('map<string,variant>')})", known)


def _transform(array: str, body: Callable[[str, str], str]) -> str:
    number = next(_lambda_names)
    item, index = f"x{number}", f"i{number}"
    return f"transform({array}, ({item}, {index}) -> {body(item, index)})"


def _without(names: str, known: list[str]) -> str:
    return f"array_except({names}, array({', '.join(map(sql_text, known))}))" if known else names


class TypedValue:
    """A typed column. ``nullable`` says whether a NULL in it counts as a null value."""

    def __init__(self, x: str, dtype: T.DataType, nullable: bool, null_as: str = "absent"):
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            x, dtype = f"CAST({x} AS STRING)", T.StringType()
        self.x, self.dtype, self.nullable, self.null_as = x, dtype, nullable, null_as

    def settle(self, schema_type: str) -> TypedValue:
        if not self.nullable or schema_type == "null":
            return self
        value = copy.copy(self)
        value.nullable = False
        return value

    def _is(self, *types: type) -> Answer:
        return both(isinstance(self.dtype, types), f"({self.x} IS NOT NULL)" if self.nullable else True)

    def is_string(self) -> Answer:
        return self._is(T.StringType)

    def is_boolean(self) -> Answer:
        return self._is(T.BooleanType)

    def is_integer(self) -> Answer:
        return self._is(T.IntegralType)

    def is_number(self) -> Answer:
        return self._is(T.NumericType)

    def is_array(self) -> Answer:
        return self._is(T.ArrayType)

    def is_object(self) -> Answer:
        return self._is(T.StructType, T.MapType)

    def is_null(self) -> Answer:
        if isinstance(self.dtype, T.NullType):
            return True
        return f"({self.x} IS NULL)" if self.nullable else False

    def type_name(self) -> str:
        names = (
            (T.StringType, "'str'"),
            (T.IntegralType, "'int'"),
            (T.NumericType, "'float'"),
            (T.BooleanType, "'bool'"),
            (T.ArrayType, "'list'"),
            ((T.StructType, T.MapType), "'dict'"),
            (T.NullType, "'NoneType'"),
        )
        name = next((n for kind, n in names if isinstance(self.dtype, kind)), None)
        if name is None:
            raise ValueError(f"cast columns of type {self.dtype.simpleString()} to text first")
        return self._unless_null("'NoneType'", name)

    def _unless_null(self, null: str, otherwise: str) -> str:
        return f"if({self.x} IS NULL, {null}, {otherwise})" if self.nullable else otherwise

    def string(self) -> str:
        return self.x

    def boolean(self) -> str:
        return self.x

    def compare(self, sign: str, limit: float) -> str:
        shown = f"{limit!r}D" if isinstance(limit, float) else str(int(limit))
        found = f"({self.x} {sign} {shown})"
        if isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            return f"({found} AND NOT isnan({self.x}))"
        return found

    def number_text(self) -> str:
        if isinstance(self.dtype, T.IntegralType):
            return f"CAST({self.x} AS STRING)"
        return python_float(self.x)

    def text(self) -> str:
        if isinstance(self.dtype, T.StringType):
            shown = python_string(self.x)
        elif isinstance(self.dtype, T.NumericType):
            shown = self.number_text()
        elif isinstance(self.dtype, T.BooleanType):
            shown = f"if({self.x}, 'True', 'False')"
        elif isinstance(self.dtype, T.NullType):
            return "'None'"
        else:
            shown = f"to_json({self.x})"
        return self._unless_null("'None'", shown)

    def among(self, choices: list) -> str:
        known = _Choices(choices)
        if isinstance(self.dtype, T.StringType):
            found = known.has_string(self.x)
        elif isinstance(self.dtype, T.IntegralType):
            found = known.has_whole(self.x)
        elif isinstance(self.dtype, T.NumericType):
            found = known.has_number(f"CAST({self.x} AS DOUBLE)")
        elif isinstance(self.dtype, T.BooleanType):
            found = known.has_whole(f"CAST({self.x} AS BIGINT)")
        elif isinstance(self.dtype, T.NullType):
            return known.has_null
        else:
            found = known.has_nested(f"to_json(to_variant_object({self.x}))")
        return self._unless_null(known.has_null, found)

    def size(self) -> str:
        return f"size({self.x})"

    def each(self, check: Callable[[Any, str], str], expected: Any = None) -> str:
        kind = self.dtype.elementType
        if isinstance(kind, T.VariantType):
            return _transform(self.x, lambda item, i: check(VariantValue(item), i))
        return _transform(self.x, lambda item, i: check(TypedValue(item, kind, True, self.null_as), i))

    def _field(self, name: str) -> str:
        if isinstance(self.dtype, T.MapType):
            return f"try_element_at({self.x}, {sql_text(name)})"
        return f"{self.x}.{quote_column(name)}"

    def child(self, name: str) -> tuple[Answer, Any]:
        if isinstance(self.dtype, T.MapType):
            dtype, present = self.dtype.valueType, f"map_contains_key({self.x}, {sql_text(name)})"
        elif name in self.dtype.fieldNames():
            dtype, present = self.dtype[name].dataType, True
        else:
            return False, None
        value, absent = self._field(name), self.null_as == "absent"
        if absent or isinstance(dtype, T.VariantType):
            present = both(present, f"({value} IS NOT NULL)")
        if isinstance(dtype, T.VariantType):
            return present, VariantValue(value)
        return present, TypedValue(value, dtype, not absent, self.null_as)

    def extra_names(self, known: list[str]) -> tuple[list[tuple[Answer, str]], str | None]:
        if isinstance(self.dtype, T.MapType):
            return [], _without(f"map_keys({self.x})", known)
        extra = sorted(set(self.dtype.fieldNames()) - set(known))
        return [(self.child(name)[0], name) for name in extra], None


class RowValue(TypedValue):
    """All columns of a DataFrame as one object, without building a struct."""

    def __init__(self, schema: T.StructType, null_as: str = "absent"):
        super().__init__("TRUE", schema, False, null_as)

    def _field(self, name: str) -> str:
        return quote_column(name)


def column(answer: Answer):
    """An answer as a Column."""
    return F.expr(as_sql(answer))
