"""JSON text: strict parsing, payloads inside noisy responses, canonical form and row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Fixed patterns: the tags around reasoning, and the first fenced block of a response.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
FENCE = "```"
FENCED_BLOCK = rf"(?s)^.*?{FENCE}(?iu:json)?(.*?){FENCE}.*\z"
FIRST_BRACKET = r"(?s)[\{\[].*"

# Where a number may stand that variant text does not keep apart: 1 and 1.0, or beyond 38
# digits. Text values can look the same; they only cost the slower way.
_UNSAFE_NUMBER = r"[:\[,]\s*-?[0-9]++(?:[.eE]|(?<=[0-9]{39}))"
_STRING_OR_NUMBER = (
    r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    r"|(-?[0-9]++(?:\.[0-9]++(?:[eE][-+]?[0-9]++)?|[eE][-+]?[0-9]++)|-?[0-9]{39,}+)"
)


# The plain parser takes no string of 20,000,000 characters; the reader's parser takes any, up to
# the size of a VARIANT (128 MiB). What is longer is an error, never a broken row.
PLAIN_PARSED = 19_000_000
MOST_PARSED = 60_000_000


def parse_json(text: Column) -> Column:
    """The text as VARIANT, NULL if it does not begin with a JSON value; long strings included."""
    long = F.from_json(text, "variant", {"maxStringLen": str(2**31 - 1)})
    return F.when(F.length(text) > PLAIN_PARSED, long).otherwise(F.try_parse_json(text))


def with_parsed(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: the text column as VARIANT, NULL unless the whole text is one JSON value.

    ``try_parse_json`` ignores whatever follows the first value. Here the text is parsed as
    the first of two array items, and the second, a hash of the text, must come back.
    The pair is a column of its own so that each text is parsed once.
    """
    pair, mark = f"__{into}_pair", F.xxhash64(F.col(text))
    size = F.length(text)
    wrapped = F.concat(F.lit("["), F.col(text), F.lit(","), mark.cast("string"), F.lit("]"))
    whole = (F.try_variant_get(pair, "$[1]", "bigint") == mark) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    value = F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))
    too_long = F.concat(F.lit("a JSON text of "), size.cast("string"), F.lit(" characters is beyond what can be parsed"))
    refused = (size > MOST_PARSED) & value.isNull()
    value = F.when(refused, F.raise_error(too_long).cast("variant")).otherwise(value)
    return df.withColumn(pair, parse_json(wrapped)).withColumn(into, value).drop(pair)


def _without_reasoning(text: Column) -> Column:
    """Drop each block from an opening tag to the next closing tag; unclosed ones stay.

    The text is cut after every closing tag, and a piece that ends in one loses all from its
    first opening tag on. One pattern over the whole text would look for the end of every
    unclosed tag anew.
    """
    pieces = F.split(text, f"(?iu)(?<={THINK_CLOSE})", -1)
    dropped = F.concat_ws(
        "",
        F.transform(
            pieces,
            lambda piece: F.when(
                F.lower(F.right(piece, F.lit(len(THINK_CLOSE)))) == THINK_CLOSE,
                F.regexp_replace(piece, f"(?isu){THINK_OPEN}.*\\z", ""),
            ).otherwise(piece),
        ),
    )
    closes = text.contains(THINK_CLOSE[:2]) & text.rlike(f"(?iu){THINK_CLOSE}")
    return F.when(closes, dropped).otherwise(text)


def clean_response(text: Column) -> Column:
    """Drop reasoning blocks; keep the body of the first fenced block if there is one.

    Plain substring tests come first: most texts then need no pattern at all.
    """
    cleaned = _without_reasoning(strip(text))
    fenced = F.regexp_replace(cleaned, FENCED_BLOCK, "$1")
    return strip(F.when(text.contains(FENCE), fenced).otherwise(cleaned))


def from_first_bracket(cleaned: Column) -> Column:
    """The cleaned text from its first ``{`` or ``[``; empty text if it has none."""
    return F.regexp_extract(cleaned, FIRST_BRACKET, 0)


def json_span(cleaned: Column) -> Column:
    """The first JSON object or array in the cleaned text, compact; NULL if it is not valid.

    The text must parse from the first bracket on; what follows the value is ignored.
    """
    tail = from_first_bracket(cleaned)
    long = F.raise_error(F.lit("a response of over 19,000,000 characters cannot be searched for JSON")).cast("string")
    span = F.when(F.try_parse_json(tail).isNotNull(), F.get_json_object(tail, "$"))
    return F.when(F.length(tail) > PLAIN_PARSED, long).otherwise(span)


def canonical_json(raw: Column, parsed: Column) -> Column:
    """One text per JSON value: keys sorted at every depth, no white space.

    Integers and floats stay apart (``1`` and ``1.0`` differ, ``1e2`` and ``100.0`` do not).
    Variant text prints both as ``1``, so in rows that may hold floats every float is first
    turned into a marked string; the mark is a control character, which JSON text holds only
    in escaped form.
    """
    mark = "\x01"
    # strings that begin with the mark get one more, so no string can pass for a marked float
    told_apart = lambda text: F.replace(text, F.lit('"\\u0001'), F.lit('"\\u0001\\u0001'))
    # the path function prints a text plainly, but takes no string of 20,000,000 characters; then numbers count as written
    written = F.coalesce(F.get_json_object(raw, "$"), raw)
    marked = F.regexp_replace(told_apart(written), _STRING_OR_NUMBER, f"$1{mark}$2{mark}")
    marked = F.replace(marked, F.lit(mark * 2), F.lit(""))
    marked = F.regexp_replace(marked, f"{mark}([^{mark}]+){mark}", r'"\\u0001$1"')
    long = F.from_json(marked, "variant", {"maxStringLen": str(2**31 - 1)})
    exact = F.to_json(F.when(F.length(raw) > PLAIN_PARSED, long).otherwise(F.try_parse_json(marked)))
    is_number = F.ascii(raw).between(ord("0"), ord("9")) | raw.startswith("-")
    may_hold_floats = is_number | raw.rlike(_UNSAFE_NUMBER)
    # a bare string loses its quotes on the way through a path, and holds no number
    plain = told_apart(F.to_json(parsed))
    return F.when(may_hold_floats & ~raw.startswith('"'), exact).otherwise(plain)


def row_key(canonical: Column) -> Column:
    """A 32-byte key for exact comparison of canonical texts."""
    return F.unhex(F.sha2(canonical, 256))
