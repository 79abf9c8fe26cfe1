"""Join verdicts to rows by batch and index, filter by score, and fail closed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import Plan, Profile
from ..session import stage
from .batches import row_batches
from .merge import DUPLICATE, KEY, key_of
from .validate import is_valid, outputs, validate_rows

NO_RESPONSE = "no_response"


def align_verdicts(batched: DataFrame, verdicts: DataFrame, batch_size: int) -> DataFrame:
    """Add the verdict of each row, and ``batch_error`` where its batch cannot be trusted.

    ``batched`` has ``batch_id``, ``pos`` and ``batch_n``. ``verdicts`` has ``batch_id``,
    ``idx``, ``is_valid``, ``score``, ``issues`` and maybe ``ord`` and ``error`` (see
    ``explode_verdicts``). A batch is refused as a whole if its verdicts are missing, too few
    or too many, out of range, repeated or incomplete; none of its rows is lost.

    Verdicts are first reduced to one per index below ``batch_size``, so the list built per
    batch has no more entries than a batch has rows, however many verdicts came back for it.
    Whole rows are shuffled once, by batch.
    """
    if "error" not in verdicts.columns:
        verdicts = verdicts.withColumn("error", _row_problem())
    if "ord" not in verdicts.columns:
        verdicts = verdicts.withColumn("ord", F.lit(0))
    counted = F.col("ord").isNotNull()
    usable = F.coalesce((F.col("idx") >= 0) & (F.col("idx") < batch_size), F.lit(False))
    per_index = verdicts.groupBy("batch_id", F.when(usable, F.col("idx")).cast("int").alias("idx")).agg(
        F.count_if(counted).alias("n"),
        F.count_if(counted & ~usable).alias("outside"),
        F.min("error").alias("error"),
        F.any_value(F.struct("is_valid", "score", "issues")).alias("verdict"),
    )
    entry = F.struct(F.col("idx").alias("key"), F.col("verdict").alias("value"))
    per_batch = per_index.groupBy("batch_id").agg(
        F.sum("n").alias("__n"),
        F.sum("outside").alias("__outside"),
        F.max(F.when(F.col("idx").isNotNull(), F.col("n"))).alias("__most"),
        F.max("idx").alias("__last"),
        F.min("error").alias("__error"),
        F.map_from_entries(F.collect_list(F.when(F.col("idx").isNotNull(), entry))).alias("__by_pos"),
    )
    problem = (
        F.when(F.col("__n").isNull(), NO_RESPONSE)
        .when((F.col("__n") == 0) & F.col("__error").isNotNull(), F.col("__error"))
        .when(F.col("__n") != F.col("batch_n"), "count_mismatch")
        .when((F.col("__outside") > 0) | (F.col("__last") >= F.col("batch_n")), "bad_index")
        .when(F.col("__most") > 1, "duplicate_index")
        .otherwise(F.col("__error"))
    )
    joined = batched.join(per_batch, "batch_id", "left").withColumn("batch_error", problem)
    found = F.when(F.col("batch_error").isNull(), F.try_element_at("__by_pos", "pos"))
    return (
        joined.withColumn("__verdict", found)
        .withColumns(
            {
                "verdict_valid": F.col("__verdict.is_valid"),
                "verdict_score": F.col("__verdict.score"),
                "verdict_issues": F.col("__verdict.issues"),
            }
        )
        .drop("__verdict", "__by_pos", "__n", "__outside", "__most", "__last", "__error")
    )


def _row_problem() -> Column:
    return F.when(F.col("is_valid").isNull(), "missing_is_valid").when(
        F.col("is_valid") & F.col("score").isNull(), "bad_score"
    )


def apply_verdicts(aligned: DataFrame, min_score: float = 0.7) -> DataFrame:
    """Add ``status`` (``accepted`` or ``rejected``), ``issues`` and ``score``.

    A row passes if its verdict is valid and its score reaches ``min_score``. Every row of a
    refused batch is rejected with ``validator_error: <reason>`` and score 0.0.
    """
    failed = F.col("batch_error").isNotNull()
    passes = F.coalesce(~failed & F.col("verdict_valid") & (F.col("verdict_score") >= min_score), F.lit(False))
    no_issues = F.array().cast("array<string>")
    return aligned.withColumns(
        {
            "status": F.when(passes, "accepted").otherwise("rejected"),
            "issues": F.when(failed, F.array(F.concat(F.lit("validator_error: "), F.col("batch_error"))))
            .when(passes, no_issues)
            .otherwise(F.coalesce("verdict_issues", no_issues)),
            "score": F.when(failed, 0.0).otherwise(F.col("verdict_score")),
        }
    ).drop("verdict_valid", "verdict_score", "verdict_issues")


def quality_gate(
    rows: DataFrame,
    plan: Plan,
    verdicts_for,
    *,
    min_score: float = 0.7,
    columns: Sequence[str] | None = None,
    profiles: dict[str, Profile] | None = None,
    seq: str = "seq",
) -> DataFrame:
    """Check, score and dedupe rows; ``status`` is ``accepted``, ``rejected`` or ``duplicate``.

    Rows with issues are rejected and not scored. The others are batched, and
    ``verdicts_for(batched)`` returns the verdicts: from a table, or by running a scorer over
    ``score_requests(batched, plan)``. Rows that pass are then compared, and exact copies of
    an earlier one rejected too. ``batch_error`` tells which batches failed.
    """
    outputs(rows, ("status", "issues", "score", "batch_id", "pos", "batch_n", "batch_error"))
    checked = validate_rows(rows, plan, columns=columns, profiles=profiles)
    checked = checked.withColumn(KEY, F.when(is_valid(), key_of(columns, rows)))
    if columns is None:
        checked = checked.drop("v")
    checked = stage(checked, "gate")
    # a scorer is shown the text (or the columns); numbering and alignment carry order alone besides
    batched = row_batches(checked.where(is_valid()).drop(KEY, "issues"), plan.rows_per_batch, seq)
    aligned = align_verdicts(batched, verdicts_for(batched), plan.rows_per_batch)
    judged = ["status", "issues", "score", "batch_id", "pos", "batch_n", "batch_error"]
    scored = apply_verdicts(aligned, min_score).select(F.col(seq).alias("__seq"), *[F.col(c).alias(f"__{c}") for c in judged])
    scored = stage(scored, "verdicts")  # slim, and read once for the first of each key and once for the rows
    slim = checked.where(is_valid()).select(F.col(seq).alias("__seq"), KEY)
    passed = scored.where("__status = 'accepted'").join(slim, "__seq")
    firsts = passed.groupBy(KEY).agg(F.min("__seq").alias("__seq")).select("__seq", F.lit(True).alias("__first"))
    decided = scored.join(firsts, "__seq", "left")
    joined = checked.join(decided, checked[seq] == decided["__seq"], "left")
    copied = (F.col("__status") == "accepted") & F.col("__first").isNull()
    no_verdict = F.col("__status").isNull()
    return joined.withColumns(
        {
            "status": F.when(no_verdict, "rejected").when(copied, "duplicate").otherwise(F.col("__status")),
            "issues": F.when(no_verdict, F.col("issues")).when(copied, F.array(F.lit(DUPLICATE))).otherwise(F.col("__issues")),
            "score": F.when(no_verdict | copied, 0.0).otherwise(F.col("__score")),
            **{c: F.col(f"__{c}") for c in judged[3:]},
        }
    ).drop(KEY, "__seq", "__first", *[f"__{c}" for c in judged])


def gate_counts() -> list[Column]:
    """The counts of a gate as aggregates; a refused batch is counted by the first of its rows, which are all there."""
    accepted = F.count_if(F.col("status") == "accepted")
    return [
        F.count(F.lit(1)).alias("raw_sample_count"),
        accepted.alias("valid_count"),
        (F.count(F.lit(1)) - accepted).alias("rejected_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"),
        F.count_if(F.col("batch_error").isNotNull() & (F.col("pos") == 0)).alias("validation_error_batches"),
    ]


def gate_metrics(gated: DataFrame) -> DataFrame:
    """Counts of a gate in one row; accepted and rejected are those after dedupe."""
    if "pos" in gated.columns:
        return gated.agg(*gate_counts())
    failed = F.count_distinct(F.when(F.col("batch_error").isNotNull(), F.col("batch_id")))
    return gated.withColumn("pos", F.lit(None).cast("int")).agg(*gate_counts()[:-1], failed.alias("validation_error_batches"))
