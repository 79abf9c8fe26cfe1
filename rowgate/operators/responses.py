"""JSON out of model responses: payloads, exploded rows and verdicts, repair messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import clean_response, from_first_bracket, parse_json
from ..functions.values import VariantValue, case, negate
from ..sources.rows import json_elements

# Error texts of a response without payload or of the wrong shape.
NO_PAYLOAD = "No JSON object/array payload found in response"
NOT_SAMPLES = "Expected a list of samples, got "
NOT_VERDICTS = "Expected a list of validation results, got "
INVALID_JSON = "invalid JSON in response"


def _parsed(responses: DataFrame, text: str) -> DataFrame:
    """Add ``__tail``, the cleaned text from its first bracket on, ``v`` and ``reason``."""
    return (
        responses.withColumn("__tail", from_first_bracket(clean_response(F.col(text))))
        .withColumn("v", parse_json(F.col("__tail")))
        .withColumn(
            "reason",
            F.when(F.coalesce("__tail", F.lit("")) == "", "no_payload").when(F.col("v").isNull(), "bad_json"),
        )
    )


def parse_payload(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add ``span`` (JSON text), ``v`` (VARIANT) and ``reason`` (NULL, ``no_payload``, ``bad_json``).

    The payload is the first object or array in the cleaned text. It must parse from its
    first bracket on; text after it is ignored.
    """
    span = F.when(F.col("v").isNotNull(), F.get_json_object("__tail", "$"))
    return _parsed(responses, text).withColumn("span", span).drop("__tail")


def _error(shape_fits: Column, wrong_shape: str) -> Column:
    return (
        F.when(F.col("reason") == "no_payload", NO_PAYLOAD)
        .when(F.col("reason") == "bad_json", INVALID_JSON)
        .when(~shape_fits, F.concat(F.lit(wrong_shape), F.expr(VariantValue("v").type_name())))
    )


def with_samples(responses: DataFrame, text: str = "text") -> DataFrame:
    """Parse responses that hold rows: an array, or an object with an array ``samples``.

    Adds ``error`` (NULL if the shape fits) and the array ``elements`` of ``(raw, v)``, NULL
    in refused responses.
    """
    is_list = F.startswith("__tail", F.lit("["))
    parsed = _parsed(responses, text).withColumns(
        {
            "__list": F.when(is_list, F.col("v")).otherwise(F.try_variant_get("v", "$.samples", "variant")),
            "__text": F.when(is_list, F.col("__tail")).otherwise(F.get_json_object("__tail", "$.samples")),
        }
    )
    fits = is_list | F.coalesce(F.schema_of_variant("__list").startswith("ARRAY<"), F.lit(False))
    listed = F.when(F.col("reason").isNull() & fits, F.col("__list"))
    shaped = parsed.withColumns({"error": _error(fits, NOT_SAMPLES), "elements": json_elements("__text", listed)})
    return shaped.drop("__tail", "__list", "__text", "v", "reason")


def with_verdicts(responses: DataFrame, text: str = "text") -> DataFrame:
    """Parse responses that hold a JSON array of verdicts; adds ``error`` and ``verdicts``."""
    fits = F.startswith("__tail", F.lit("["))
    listed = F.when(F.col("reason").isNull() & fits, F.col("v")).cast("array<variant>")
    parsed = _parsed(responses, text).withColumns({"error": _error(fits, NOT_VERDICTS), "verdicts": listed})
    return parsed.drop("__tail", "v", "reason")


def explode_samples(responses: DataFrame, text: str = "text", keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """One row per generated row: ``pos``, ``raw``, ``v``; refused responses have none.

    Use ``with_samples`` to see the refused ones.
    """
    # A filter on ``error``, or the one that an inner explode implies, would be pushed below
    # the parsing and run it twice; one on ``pos`` stays above the explode.
    exploded = with_samples(responses, text).select(*keys, F.posexplode_outer("elements").alias("pos", "e"))
    return exploded.where("pos IS NOT NULL").select(*keys, "pos", "e.raw", "e.v")


def explode_verdicts(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per verdict: ``ord``, ``idx``, ``is_valid``, ``score``, ``issues``, ``error``.

    A response without usable verdicts yields one row with ``ord`` NULL and its ``error``, so
    that the batch is not lost. Missing and wrong entries are told apart in ``error`` too:
    ``bad_index``, ``missing_is_valid`` and ``bad_score`` are found here.
    """
    shaped = with_verdicts(responses, text)
    if "scorer_error" in shaped.columns:
        shaped = shaped.withColumn("error", F.coalesce("scorer_error", "error"))
    one = shaped.select("batch_id", "error", F.posexplode_outer("verdicts").alias("ord", "e"))
    # an empty array leaves one row without a verdict; it counts as zero verdicts
    verdict = VariantValue("e")
    (has_index, index), (_, valid) = verdict.child("index"), verdict.child("is_valid")
    (has_score, score), (has_issues, issues) = verdict.child("score"), verdict.child("issues")
    is_valid = F.expr(case((valid.is_boolean(), valid.boolean())))
    number = case((score.is_boolean(), f"CAST({score.boolean()} AS DOUBLE)"), (score.is_number(), score.get("double")))
    index_of = case(
        (negate(has_index), "CAST(ord AS BIGINT)"),
        (index.is_boolean(), f"CAST({index.boolean()} AS BIGINT)"),
        (index.is_integer(), index.get("bigint")),
    )
    one_text = "if(schema_of_variant(x) = 'STRING', try_variant_get(x, '$', 'string'), to_json(x))"
    texts = case(
        ("ord IS NULL", "NULL"),
        (issues.is_array(), f"transform({issues.get('array<variant>')}, x -> {one_text})"),
        (issues.is_string(), f"array({issues.string()})"),
        (has_issues, f"array(to_json({issues.x}))"),
        otherwise="CAST(array() AS ARRAY<STRING>)",
    )
    parsed = one.select(
        "batch_id",
        "error",
        "ord",
        F.expr(index_of).alias("idx"),
        is_valid.alias("is_valid"),
        F.when(F.expr(f"ord IS NULL OR {has_score}"), F.expr(number)).when(is_valid, 1.0).otherwise(0.0).alias("score"),
        F.expr(texts).alias("issues"),
        F.expr(verdict.is_object()).alias("__object"),
    )
    problem = (
        F.when(F.col("ord").isNull(), F.lit(None).cast("string"))
        .when(~F.col("__object"), "parse_error")
        .when(F.col("idx").isNull(), "bad_index")
        .when(F.col("is_valid").isNull(), "missing_is_valid")
        .when(F.col("is_valid") & F.col("score").isNull(), "bad_score")
    )
    return parsed.withColumn("error", F.coalesce("error", problem)).drop("__object")


def repair_message(error: Column) -> Column:
    """The request to answer again, for a response that did not parse."""
    # Fixed value: the wording of the message.
    return F.concat(
        F.lit("Your previous response could not be parsed as valid JSON. Parsing error: "),
        error,
        F.lit(
            ". Return ONLY valid JSON (object or array), without markdown fences or explanation."
        ),
    )


def repair_requests(responses: DataFrame) -> DataFrame:
    """The refused responses (``error`` not NULL) with the message that asks for a repair."""
    return responses.where("error IS NOT NULL").withColumn("message", repair_message(F.col("error")))
