"""Small text helpers shared by the operators. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks as ``trim`` does."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def sql_text(text: str) -> str:
    """A string literal in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def python_float(value: str) -> str:
    """SQL for a double printed the way Python prints a float (``2.0``, ``1e+16``, ``1e-05``)."""
    text, exponent = "CAST(d AS STRING)", "substring_index(CAST(d AS STRING), 'E', -1)"
    fixed = f"TRIM(TRAILING '0' FROM CAST(TRY_CAST({text} AS DECIMAL(38,21)) AS STRING))"
    digits = f"regexp_replace({exponent}, '^-', '')"
    return (
        f"transform(array(CAST({value} AS DOUBLE)), d -> CASE WHEN isnan(d) THEN 'nan' "
        "WHEN abs(d) = DOUBLE('Infinity') THEN if(d > 0, 'inf', '-inf') "
        f"WHEN d = 0 THEN {text} "
        f"WHEN abs(d) >= 1e-4D AND abs(d) < 1e16D THEN regexp_replace({fixed}, '[.]$', '.0') "
        f"ELSE concat(regexp_replace(substring_index({text}, 'E', 1), '[.]0$', ''), 'e', "
        f"if(startswith({exponent}, '-'), '-', '+'), "
        f"lpad({digits}, greatest(2, length({digits})), '0')) END)[0]"
    )


def python_string(value: str) -> str:
    """SQL for a string quoted as by Python's ``repr`` (no escapes for unprintable text)."""
    body = "s"
    for char, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = f"replace({body}, {sql_text(char)}, {sql_text(escaped)})"
    single, escaped = sql_text("'"), sql_text("\\'")
    return (
        f"transform(array({value}), s -> if(contains(s, {single}) AND NOT contains(s, '\"'), "
        f"concat('\"', {body}, '\"'), concat({single}, replace({body}, {single}, {escaped}), {single})))[0]"
    )


def quote_column(name: str) -> str:
    """A column name safe for ``F.col``, whatever dots or ticks it holds."""
    return "`" + name.replace("`", "``") + "`"
