"""Exact dedupe and merge: accepted, duplicate and invalid rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import canonical_json, row_key
from ..plans import Plan, Profile
from ..session import stage
from ..sources.rows import read_rows
from .validate import columns_as_json, outputs, validate_rows

DUPLICATE = "duplicate_exact"
# columns that a merge adds
RESULTS = ("status", "issues", "score")


def key_of(columns: Sequence[str] | None = None, rows: DataFrame | None = None) -> Column:
    """The key of a JSON row (``raw``, ``v``) or of typed ``columns`` of ``rows``; never NULL for a valid row."""
    if columns is not None:
        return row_key(columns_as_json(columns, rows))
    return row_key(F.coalesce(canonical_json(F.col("raw"), F.col("v")), F.col("raw")))


def mark_first(rows: DataFrame, key: str = "key", seq: str = "seq", into: str = "is_first") -> DataFrame:
    """Mark the first row of each key; rows with a NULL key are not compared (NULL mark).

    The first ``seq`` of a key comes from an aggregate whose partial step shrinks a hot key
    to one row per task. The mark is joined back on ``seq``, which is unique, so no task
    ever holds all the rows of a key. One shuffle moves whole rows, two move 40 bytes a row.
    """
    # rows without a key form a group with a NULL result; a filter instead would be pushed
    # below the checks and run them twice
    first = F.min(F.when(F.col(key).isNotNull(), F.col(seq)))
    firsts = rows.groupBy(key).agg(first.alias("__first")).select("__first", F.lit(True).alias("__mark"))
    marked = rows.join(firsts, rows[seq] == firsts["__first"], "left")
    mark = F.when(F.col(key).isNotNull(), F.coalesce("__mark", F.lit(False)))
    return marked.withColumn(into, mark).drop("__first", "__mark")


KEY, FIRST = "__key", "__is_first"


def dedupe_rows(
    rows: DataFrame,
    *,
    columns: Sequence[str] | None = None,
    seq: str = "seq",
    into: str = "is_first",
    stage_keyed: bool | None = None,
) -> DataFrame:
    """Add ``is_first``: true on the row that stays, false on its exact duplicates.

    JSON rows are staged with their keys unless ``stage_keyed`` says no: their order may depend on
    how files are split, so it must be read once only, and their keys are dear.
    """
    named = outputs(rows, [into])
    keyed = rows.withColumn(KEY, key_of(columns, rows))
    if stage_keyed or stage_keyed is None and columns is None:
        keyed = stage(keyed, "keyed")
    return mark_first(keyed, KEY, seq, named[into]).drop(KEY)


def merge_rows(
    rows: DataFrame,
    plan: Plan | dict | None = None,
    *,
    columns: Sequence[str] | None = None,
    profiles: dict[str, Profile] | None = None,
    null_as: str = "absent",
    seq: str = "seq",
    stage_checked: bool | None = None,
    prefix: str = "",
) -> DataFrame:
    """Classify rows: ``status`` is ``accepted``, ``duplicate`` or ``invalid``.

    Only valid rows are compared, so a broken copy never takes the place of a good row.
    ``issues`` and ``score`` (0.0) are set on rejects. The names of the three results begin with ``prefix``; columns of
    the rows are kept, and a result that would overwrite one is an error.

    With ``stage_checked`` the checked rows are written to the staging folder once, and dedupe reads only keys
    and order from there; without, the checks run in both branches of the plan. JSON rows are staged unless
    that is turned off: their order may depend on how files are split. Typed rows are not.
    """
    named = outputs(rows, RESULTS, prefix)
    saved = {name: f"__own_{name}" for name in RESULTS if name in rows.columns}
    checked = rows.withColumns({kept: F.col(name) for name, kept in saved.items()})
    checked = validate_rows(checked, plan, columns=columns, profiles=profiles, null_as=null_as)
    # the checks' issues take a name of their own before the rows' own columns come back
    checked = checked.withColumn("__issues", F.col("issues")).drop("issues")
    checked = checked.withColumns({name: F.col(kept) for name, kept in saved.items()}).drop(*saved.values())
    checked = checked.withColumn(KEY, F.when(F.size("__issues") == 0, key_of(columns, rows)))
    if columns is None:
        checked = checked.drop("v")  # the text alone goes through the shuffle
    if stage_checked or stage_checked is None and columns is None:
        checked = stage(checked, "checked")
    return _classified(mark_first(checked, KEY, seq, FIRST), named).drop(KEY, FIRST, "__issues")


def _classified(marked: DataFrame, named: dict[str, str]) -> DataFrame:
    first, issues = F.col(FIRST), F.col("__issues")
    return marked.withColumns(
        {
            named["status"]: F.when(first.isNull(), "invalid").when(first, "accepted").otherwise("duplicate"),
            named["issues"]: F.when(~first, F.array(F.lit(DUPLICATE))).otherwise(issues),
            named["score"]: F.when(first, F.lit(None).cast("double")).otherwise(F.lit(0.0)),
        }
    )


def with_status(marked: DataFrame) -> DataFrame:
    """Turn the mark of the first row into ``status``, ``issues`` and ``score``."""
    renamed = marked.withColumnsRenamed({"is_first": FIRST, "issues": "__issues"})
    return _classified(renamed, {name: name for name in RESULTS}).drop(FIRST, "__issues")


def merge_inputs(
    spark: SparkSession,
    inputs: Sequence[str],
    plan: Plan | None = None,
    *,
    profiles: dict[str, Profile] | None = None,
    mode: str = "quarantine",
    fmt: str | None = None,
) -> DataFrame:
    """Read inputs of any format (or of ``fmt``) and merge them. The text is parsed once, then staged."""
    return merge_rows(read_rows(spark, inputs, mode, fmt), plan, profiles=profiles, stage_checked=True)


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("status = 'accepted'").drop("status", "issues", "score")


def rejected(classified: DataFrame) -> DataFrame:
    """Every row that was not accepted, with its issues and score."""
    return classified.where("status <> 'accepted'")


def merge_counts() -> list[Column]:
    """The counts of a merge as aggregates, which may also be observed while its rows are written."""
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("raw_sample_count"),
        F.count_if(status == "accepted").alias("valid_count"),
        F.count_if(status != "accepted").alias("rejected_count"),
        F.count_if(status == "duplicate").alias("duplicate_count"),
        F.count_if(status.isin("invalid", "rejected")).alias("invalid_count"),
    ]


def merge_metrics(classified: DataFrame) -> DataFrame:
    """Counts of a merge, or of a gate, in one row: every row that was not accepted is a reject."""
    return classified.agg(*merge_counts())
