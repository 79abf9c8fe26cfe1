"""Row checks compiled once, on the driver, to one expression of issues.

Three checks: a JSON Schema subset, the older flat field list, and rules for code text. Each
gives an array of strings in the order in which a person would read the schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import quote_column, sql_text, strip
from .values import (
    SCHEMA_TYPES,
    Answer,
    Bindings,
    RowValue,
    TypedValue,
    VariantValue,
    as_sql,
    both,
    column,
    either,
    negate,
)

Value = VariantValue | TypedValue

_NONE = "CAST(array() AS ARRAY<STRING>)"

# Messages behind one test; more of them would make one expression too deep.
_GROUP = 30


def no_issues() -> Column:
    return F.expr(_NONE)


class _Text(str):
    """Marks literal text among the parts of a message; other parts are SQL."""


def _text(*parts: str) -> str:
    """SQL that joins literal texts (``_Text``) and SQL parts, merging neighbouring literals."""
    merged: list[str] = []
    for part in parts:
        if isinstance(part, _Text) and merged and isinstance(merged[-1], _Text):
            merged[-1] = _Text(merged[-1] + part)
        else:
            merged.append(part)
    shown = [sql_text(p) if isinstance(p, _Text) else p for p in merged]
    return shown[0] if len(shown) == 1 else f"concat({', '.join(shown)})"


class _Issues:
    """Collects optional messages and, for array items and extra keys, lists of messages.

    Messages are built behind one test of all conditions, so a row without issues pays only
    for those. Lists are concatenated rather than filtered: ``concat`` runs as generated
    code, while a higher-order function would take every expression inside it out of that.
    """

    def __init__(self) -> None:
        self._parts: list[str | list[tuple[Answer, str]]] = []

    def add(self, condition: Answer, message: str) -> None:
        if condition is False:
            return
        if not self._parts or not isinstance(self._parts[-1], list) or len(self._parts[-1]) == _GROUP:
            self._parts.append([])
        self._parts[-1].append((condition, message))

    def add_list(self, condition: Answer, messages: str) -> None:
        if condition is not False:
            self._parts.append(messages if condition is True else f"if({condition}, {messages}, {_NONE})")

    @staticmethod
    def _messages(found: list[tuple[Answer, str]]) -> str:
        if len(found) == 1:
            return f"array({found[0][1]})"
        singles = [f"array({m})" if on is True else f"if({on}, array({m}), {_NONE})" for on, m in found]
        return f"concat({', '.join(singles)})"

    @staticmethod
    def _any(found: list[tuple[Answer, str]]) -> Answer:
        return reduce(either, (condition for condition, _ in found))

    def sql(self) -> str:
        lists = []
        for part in self._parts:
            if isinstance(part, list):
                broken, messages = self._any(part), self._messages(part)
                part = messages if broken is True else f"if({broken}, {messages}, {_NONE})"
            lists.append(part)
        if not lists:
            return _NONE
        return lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"

    def sql_if_any(self) -> str:
        """Like ``sql``, but NULL instead of an empty list where that is cheap to tell."""
        if len(self._parts) == 1 and isinstance(self._parts[0], list):
            broken, messages = self._any(self._parts[0]), self._messages(self._parts[0])
            return messages if broken is True else f"if({broken}, {messages}, NULL)"
        return self.sql()


def _check(value: Value, schema: dict, path: tuple, gate: Answer, out: _Issues) -> None:
    kind = schema.get("type")
    if isinstance(kind, str):
        if kind not in SCHEMA_TYPES:
            out.add(gate, _text(*path, _Text(f": unsupported schema type '{kind}'")))
            return
        fits = getattr(value, f"is_{kind}")()
        if kind == "number":  # a boolean counts as a number
            fits = either(fits, value.is_boolean())
        out.add(both(gate, negate(fits)), _text(*path, _Text(f": expected {kind}, got "), value.type_name()))
        gate, value = both(gate, fits), value.settle(kind)
    if gate is False:
        return

    if "enum" in schema:
        choices = schema.get("enum") or []
        out.add(
            both(gate, negate(value.among(choices))),
            _text(*path, _Text(": value "), value.text(), _Text(f" not in enum {choices!r}")),
        )
    _check_string(value, schema, path, both(gate, value.is_string()), out)
    _check_number(value, schema, path, both(gate, value.is_number()), out)
    _check_array(value, schema, path, both(gate, value.is_array()), out)
    _check_object(value, schema, path, both(gate, value.is_object()), out)


def _check_limits(size: str, rules: tuple, path: tuple, gate: Answer, out: _Issues) -> None:
    for limit, sign, what in rules:
        if isinstance(limit, int):
            message = _text(*path, _Text(f": {what} ("), f"CAST({size} AS STRING)", _Text(f" {sign} {limit})"))
            out.add(both(gate, f"({size} {sign} {int(limit)})"), message)


def _check_string(value: Value, schema: dict, path: tuple, gate: Answer, out: _Issues) -> None:
    if gate is not False:
        shortest = (schema.get("minLength"), "<", "string too short")
        longest = (schema.get("maxLength"), ">", "string too long")
        _check_limits(f"length({value.string()})", (shortest, longest), path, gate, out)


def _check_number(value: Value, schema: dict, path: tuple, gate: Answer, out: _Issues) -> None:
    if gate is False:
        return
    for key, sign, what in (("minimum", "<", "below minimum"), ("maximum", ">", "above maximum")):
        limit = schema.get(key)
        if isinstance(limit, (int, float)):
            message = _text(*path, _Text(": value "), value.number_text(), _Text(f" {what} {limit}"))
            out.add(both(gate, value.compare(sign, limit)), message)


def _check_array(value: Value, schema: dict, path: tuple, gate: Answer, out: _Issues) -> None:
    if gate is False:
        return
    fewest = (schema.get("minItems"), "<", "array too short")
    most = (schema.get("maxItems"), ">", "array too long")
    _check_limits(value.size(), (fewest, most), path, gate, out)
    items = schema.get("items")
    if isinstance(items, dict):

        def check_item(item: Value, index: str) -> str:
            found = _Issues()
            _check(item, items, (*path, _Text("["), f"CAST({index} AS STRING)", _Text("]")), True, found)
            return found.sql_if_any()

        out.add_list(gate, f"flatten(array_compact({value.each(check_item, items.get('type'))}))")


def _check_object(value: Value, schema: dict, path: tuple, gate: Answer, out: _Issues) -> None:
    if gate is False:
        return
    required, properties = schema.get("required", []), schema.get("properties", {})
    children: dict[str, tuple[Answer, Any]] = {}

    def child(name: str) -> tuple[Answer, Any]:
        if name not in children:
            children[name] = value.child(name)
        return children[name]

    if isinstance(required, list):
        for name in required:
            out.add(both(gate, negate(child(name)[0])), _text(*path, _Text(f": missing required field '{name}'")))
    if not isinstance(properties, dict):
        return
    for name, rules in properties.items():
        if isinstance(rules, dict):
            present, field = child(name)
            if both(gate, present) is not False:
                _check(field, rules, (*path, _Text(f".{name}")), both(gate, present), out)
    if schema.get("additionalProperties") is False:
        single, listed = value.extra_names(list(properties))
        for present, name in single:
            out.add(both(gate, present), _text(*path, _Text(f": unexpected field '{name}'")))
        if listed is not None:
            message = _text(*path, _Text(": unexpected field '"), "name", _Text("'"))
            named = f"transform(sort_array({listed}), name -> {message})"
            out.add_list(both(gate, f"(size({listed}) > 0)"), named)


def _root(df: DataFrame, value: str | None, columns: Sequence[str] | None, null_as: str):
    """The value to check: the VARIANT column ``value``, or typed ``columns`` as one object."""
    if value is not None:
        bindings = Bindings("check")
        return VariantValue(quote_column(value), bindings, kind=kind_of_row(df, value)), bindings
    names = columns if columns is not None else df.columns
    return RowValue(T.StructType([df.schema[name] for name in names]), null_as), Bindings("check")


def kind_of_row(df: DataFrame, value: str) -> str | None:
    """The type of whole rows, read off their JSON text if there is one.

    For an object ``schema_of_variant`` describes every field, which is not needed here.
    """
    if "raw" not in df.columns:
        return None
    return (
        f"CASE WHEN {quote_column(value)} IS NULL THEN NULL WHEN startswith(raw, '{{') THEN 'OBJECT<' "
        f"WHEN startswith(raw, '[') THEN 'ARRAY<' ELSE schema_of_variant({quote_column(value)}) END"
    )


def with_schema_issues(
    df: DataFrame,
    schema: dict,
    *,
    value: str | None = None,
    columns: Sequence[str] | None = None,
    into: str = "issues",
    null_as: str = "absent",
) -> DataFrame:
    """Add the column ``into`` with every issue of a row against a JSON Schema subset.

    Rows are the VARIANT column ``value``, or else the typed ``columns`` (default: all). In
    typed columns a NULL means that the key is absent, or with ``null_as="null"`` a null.
    """
    root, bindings = _root(df, value, columns, null_as)
    out = _Issues()
    _check(root, schema, (_Text("$"),), True, out)
    return bindings.drop_from(bindings.add_to(df).withColumn(into, F.expr(out.sql())))


def with_field_issues(
    df: DataFrame,
    fields: Sequence[dict],
    *,
    value: str | None = None,
    columns: Sequence[str] | None = None,
    into: str = "issues",
    null_as: str = "absent",
) -> DataFrame:
    """Add the column ``into`` with the issues of the older flat check.

    ``fields`` are dicts with ``name``, ``field_type`` and ``constraints``. This check goes on
    after a wrong type, counts booleans as integers, and does not look into lists.
    """
    root, bindings = _root(df, value, columns, null_as)
    out = _Issues()
    for field in fields:
        name, kind = field["name"], field["field_type"]
        present, found = root.child(name)
        out.add(negate(present), _text(_Text(f"Missing field: {name}")))
        if present is not False:
            _check_field(found, name, kind, field.get("constraints") or {}, present, out)
    single, listed = root.extra_names([field["name"] for field in fields])
    if listed is None:
        named = [f"if({as_sql(on)}, {sql_text(name)}, NULL)" for on, name in single]
        listed = f"array_compact(array({', '.join(named)}))" if named else _NONE
    names = f"array_join(sort_array({listed}), ', ')"
    out.add(f"(size({listed}) > 0)", _text(_Text("Unexpected fields: "), names))
    return bindings.drop_from(bindings.add_to(df).withColumn(into, F.expr(out.sql())))


def _check_field(value: Value, name: str, kind: str, rules: dict, gate: Answer, out: _Issues) -> None:
    number = either(value.is_number(), value.is_boolean())
    fits = {
        "string": value.is_string(),
        "code": value.is_string(),
        "integer": either(value.is_integer(), value.is_boolean()),
        "float": number,
        "boolean": value.is_boolean(),
        "json": either(value.is_object(), value.is_array()),
    }
    if kind.startswith("list["):
        kind, fits["list"] = "list", value.is_array()
    if kind in fits:
        message = _text(_Text(f"Field {name}: expected {kind}, got "), value.type_name())
        out.add(both(gate, negate(fits[kind])), message)
    text_gate, number_gate = both(gate, value.is_string()), both(gate, number)
    size = f"length({value.string()})"
    for key, sign, word in (("min_length", "<", "short"), ("max_length", ">", "long")):
        if key in rules and text_gate is not False:
            message = _text(_Text(f"Field {name}: too {word} ("), f"CAST({size} AS STRING)", _Text(f" {sign} {rules[key]})"))
            out.add(both(text_gate, f"({size} {sign} {rules[key]})"), message)
    for key, sign, word in (("min_value", "<", "below minimum"), ("max_value", ">", "above maximum")):
        if key in rules and number_gate is not False:
            message = _text(_Text(f"Field {name}: value "), value.text(), _Text(f" {word} {rules[key]}"))
            out.add(both(number_gate, _number_breaks(value, sign, rules[key])), message)


def _number_breaks(value: Value, sign: str, limit: float) -> str:
    boolean, number = value.is_boolean(), value.is_number()
    if boolean is False:
        return value.compare(sign, limit)
    as_number = f"(CAST({value.boolean()} AS INT) {sign} {limit})"
    if boolean is True or number is False:
        return as_number
    return f"if({boolean}, {as_number}, {value.compare(sign, limit)})"


# Substrings of which at least one occurs in code of the language.
LANGUAGE_MARKERS = {
    "python": ("def ", "import ", "class ", "lambda ", "if __name__"),
    "rust": ("fn ", "let ", "impl ", "use ", "::"),
    "javascript": ("function ", "const ", "let ", "=>", "import "),
    "typescript": ("function ", "const ", "let ", "interface ", "type "),
}


def code_issues(
    text: Column,
    *,
    language: str,
    field: str = "code",
    disallowed: Sequence[str] = (),
    required: Sequence[str] = (),
) -> Column:
    """Issues of a code text (NULL = missing or not text): markers, banned and needed parts."""
    code, name = strip(text), language.lower()
    found = []
    markers = LANGUAGE_MARKERS.get(name, ())
    if markers:
        seen = reduce(Column.__or__, [code.contains(marker) for marker in markers])
        found.append(F.when(~seen, f"Code does not appear to match declared language '{name}'"))
    found += [F.when(code.contains(part), f"Disallowed substring found: {part}") for part in disallowed]
    found += [F.when(~code.contains(part), f"Required substring missing: {part}") for part in required]
    return (
        F.when(text.isNull(), F.array(F.lit(f"Missing or invalid code field: {field}")))
        .when(code == "", F.array(F.lit("Code content is empty")))
        .otherwise(F.array_compact(F.array(*found)) if found else no_issues())
    )


def text_field(df: DataFrame, name: str, value: str | None = None) -> Column:
    """The field ``name`` of a row if it holds text, else NULL."""
    if value is not None:
        found = VariantValue(quote_column(value)).child(name)[1]
        return F.when(column(found.is_string()), column(found.string()))
    if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
        return F.col(quote_column(name))
    return F.lit(None).cast("string")
