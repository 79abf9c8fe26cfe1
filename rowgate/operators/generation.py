"""Bookkeeping of generation runs as tables: batches, requests and an audit of sizes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Plan
from .batches import plan_section

# Batches one task unfolds at a time.
_BLOCK = 100_000


def batch_table(totals: DataFrame, batch_size: int, total: str = "total", key: str = "chunk_id") -> DataFrame:
    """The batches of each chunk: ``batch_index`` from 0 and ``n_rows``, the last may be short.

    ``totals`` has one row per chunk. A chunk is unfolded in two steps with a shuffle
    between them, so one huge chunk is spread over the cluster.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    count = F.col(total).cast("bigint")
    checked = F.when(count >= 1, count).otherwise(F.raise_error(F.lit("a chunk needs at least 1 row")).cast("bigint"))
    sized = totals.select(F.col(key), checked.alias("__total")).withColumn(
        "__batches", F.expr(f"(__total + {batch_size - 1}) div {batch_size}")
    )
    blocks = sized.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__batches - 1) div {_BLOCK})")))
    spread = blocks.repartition(key, "__block")
    last = F.least(F.col("__batches"), (F.col("__block") + 1) * _BLOCK) - 1
    batches = spread.withColumn("batch_index", F.explode(F.sequence(F.col("__block") * _BLOCK, last)))
    size = F.least(F.lit(batch_size), F.col("__total") - F.col("batch_index") * batch_size)
    return batches.select(key, "batch_index", size.cast("bigint").alias("n_rows"))


def generation_instructions(plan: Plan) -> str:
    parts = [
        "Produce rows for the dataset below. Answer with a JSON array of row objects only. Every "
        f"row has exactly these fields: {', '.join(plan.field_names)}. Rows differ from each other "
        "and from the examples, and keep to the schema.",
        plan_section(plan),
        f"Strategy: {plan.strategy}",
    ]
    if plan.axis_names:
        parts.append(f"Vary: {', '.join(plan.axis_names)}")
    if plan.example_rows:
        parts.append("Examples:\n" + json.dumps(plan.example_rows, indent=2, ensure_ascii=False))
    return "\n\n".join(parts)


def generation_requests(batches: DataFrame, plan: Plan, key: str = "chunk_id", targets: DataFrame | None = None) -> DataFrame:
    """One request per batch; ``message`` counts batches from 1 and names the chunk if any.

    With ``targets`` (see ``batch_targets``) it also says how many rows should have each value of each axis, in
    the order of the plan's axes and values; a batch without targets is asked for as without them.
    """
    size = F.col("n_rows").cast("string")
    # Fixed value: the wording of the message.
    message = F.concat(
        F.lit("Generate batch "),
        (F.col("batch_index") + 1).cast("string"),
        F.lit(" with exactly "),
        size,
        F.lit(" unique samples. Return a JSON array of "),
        size,
        F.lit(" sample objects."),
    )
    chunk = F.concat(
        F.lit(" This run belongs to chunk '"),
        F.col(key).cast("string"),
        F.lit(
            "'. Produce rows that are distinct from other chunks generated from the same plan."
        ),
    )
    message = F.concat(message, F.coalesce(chunk, F.lit("")))
    if targets is not None:
        batches = _with_targets(batches, plan, key, targets)
        message = F.concat(message, F.coalesce(F.concat(F.lit(" Rows by axis: "), "__targets", F.lit(".")), F.lit("")))
    return batches.select(
        key, "batch_index", "n_rows", F.lit(generation_instructions(plan)).alias("instructions"), message.alias("message")
    )


def _with_targets(batches: DataFrame, plan: Plan, key: str, targets: DataFrame) -> DataFrame:
    """Add the targets of each batch as text; a list has at most one entry per value of the plan's axes."""
    pairs = [f"{axis.name}\x00{value}" for axis in plan.axes for value in dict.fromkeys(axis.values)]
    # values of the plan by their places; what the plan does not have comes last
    place = F.array_position(F.lit(pairs), F.concat("axis", F.lit("\x00"), "value"))
    place = F.when(place == 0, len(pairs) + 1).otherwise(place)
    shown = F.concat("axis", F.lit(" '"), "value", F.lit("': "), F.col("count").cast("string"))
    listed = targets.groupBy(F.col(key).alias("__key"), F.col("batch_index").alias("__at")).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("k"), shown.alias("text")))).alias("__list")
    )
    listed = listed.withColumn("__targets", F.array_join(F.transform("__list", lambda t: t["text"]), "; "))
    same = [F.col(key).eqNullSafe(F.col("__key")), F.col("batch_index").eqNullSafe(F.col("__at"))]
    return batches.join(listed, same, "left")


def batch_audit(batches: DataFrame, samples: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Compare the rows that came back with those asked for: ``expected``, ``got``, ``ok``.

    A batch that nobody asked for is listed with ``expected`` 0 and is not ok. A NULL chunk or
    index is a value like others, so rows without a chunk meet the batches without one.
    """
    asked = batches.select(key, "batch_index", F.col("n_rows").cast("bigint").alias("expected"), F.lit(0).cast("bigint").alias("got"))
    got = samples.groupBy(key, "batch_index").agg(F.lit(0).cast("bigint").alias("expected"), F.count("*").alias("got"))
    # grouping takes NULLs as equal and keeps both sides, as a null-safe full outer join would
    both = asked.unionByName(got).groupBy(key, "batch_index").agg(F.sum("expected").alias("expected"), F.sum("got").alias("got"))
    return both.withColumn("ok", (F.col("expected") > 0) & (F.col("expected") == F.col("got")))


def require_complete(audit: DataFrame) -> None:
    """Raise if any batch has the wrong size."""
    wrong = audit.where(~F.col("ok"))
    first = wrong.head()
    if first is not None:
        raise ValueError(
            f"wrong batch size: batch {first['batch_index']} asked for {first['expected']} rows and got {first['got']}"
        )
