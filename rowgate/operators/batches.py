"""Dense row numbers, batches of consecutive rows, and one scoring request per batch."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import Plan
from ..session import stage


def number_rows(rows: DataFrame, seq: str = "seq", into: str = "idx", total: str | None = None) -> DataFrame:
    """Add a dense number from 0 in the order of ``seq``, without a one-task window.

    Rows are evaluated once, and staged as they stand with a number of their own. Only that and ``seq`` are then range
    partitioned, sorted and staged with their partition and place; the partition sizes, one row per partition, give each
    partition its offset. The ranks are joined back on the rows' own numbers, which Spark does without moving rows where the
    ranks are small.
    """
    own = stage(rows.withColumn("__own", F.monotonically_increasing_id()), "rows")
    placed = (
        own.select("__own", seq)
        .repartitionByRange(seq)
        .sortWithinPartitions(seq)
        .select(
            "__own",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__place"),
        )
    )
    staged = stage(placed, "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("__part")
        .count()
        .withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .withColumn("__total", F.sum("count").over(Window.partitionBy()))
        .select("__part", "__offset", "__total")
    )
    # one row per range partition, so never more than spark.sql.shuffle.partitions
    ranks = staged.join(F.broadcast(offsets), "__part").select("__own", (F.col("__offset") + F.col("__place")).alias("__rank"), "__total")
    numbered = own.join(ranks, "__own").withColumn(into, F.col("__rank"))
    if total is not None:
        numbered = numbered.withColumnRenamed("__total", total)
    return numbered.drop("__own", "__rank", "__total")


def running_total(rows: DataFrame, order: Sequence[str], value: str, into: str, per: Sequence[str] = ()) -> DataFrame:
    """Add the sum of ``value`` over the rows before each one, in the order of ``order``, without a one-task window.

    With ``per`` each group of these columns has a sum of its own. Rows are range partitioned, and staged with the number of
    their partition; a partition then adds up its own rows, and the sums of those before it come from one row per partition and
    group.
    """
    keys = [*per, *(c for c in order if c not in per)]
    placed = rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    staged = stage(placed, "parts")
    sums = staged.groupBy(*per, "__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*per).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__earlier", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    same = [F.col("__part") == F.col("__of")]
    for number, column in enumerate(per):
        sums = sums.withColumnRenamed(column, f"__per_{number}")
        same.append(F.col(column).eqNullSafe(F.col(f"__per_{number}")))
    sums = sums.withColumnRenamed("__part", "__of")
    joined = staged.join(sums, same).drop("__of", *(f"__per_{n}" for n in range(len(per))))
    inside = Window.partitionBy("__part", *per).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(into, (F.col("__earlier") + within).cast("bigint")).drop("__part", "__earlier")


def row_batches(rows: DataFrame, batch_size: int, seq: str = "seq") -> DataFrame:
    """Add ``batch_id``, ``pos`` and ``batch_n``: consecutive rows, the last batch may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    numbered = number_rows(rows, seq, "__idx", total="__rows")
    return numbered.withColumns(
        {
            "batch_id": F.expr(f"__idx div {batch_size}"),
            "pos": (F.col("__idx") % batch_size).cast("int"),
        }
    ).withColumn(
        "batch_n", F.least(F.lit(batch_size), F.col("__rows") - F.col("batch_id") * batch_size).cast("int")
    ).drop("__idx", "__rows")


def _field_line(name: str, rules: object, required: bool) -> str:
    """One line on a field: its name, kind, limits, and whether it may be left out."""
    rules = rules if isinstance(rules, dict) else {}
    limits = [f"{key} {json.dumps(rules[key], ensure_ascii=False)}" for key in sorted(rules) if key not in ("type", "description", "properties", "items")]
    facts = [str(rules.get("type", "any")), *limits, *([] if required else ["optional"])]
    return f"- {name} ({'; '.join(facts)})" + (f": {rules['description']}" if rules.get("description") else "")


def plan_summary(plan: Plan) -> str:
    """What a request has to say about a plan: its purpose, then a line per field."""
    properties, required = plan.row_schema["properties"], set(plan.row_schema.get("required") or [])
    lines = [_field_line(name, properties[name], name in required) for name in plan.field_names]
    return "\n".join([f"Rows of {plan.dataset_name!r}. {plan.description}", *lines])


def plan_section(plan: Plan) -> str:
    """Summary, row schema and rubric: the part that all requests of a plan share."""
    parts = [plan_summary(plan), "JSON Schema for each row:\n" + json.dumps(plan.row_schema, indent=2)]
    if plan.quality_rubric:
        parts.append("Quality criteria:\n" + "\n".join(f"- {item}" for item in plan.quality_rubric))
    return "\n\n".join(parts)


def scoring_instructions(plan: Plan) -> str:
    return (
        "Judge each row against the schema and the criteria below. Answer with a JSON array only: "
        'one object per row with "index" (0-based position in the request), "is_valid" (boolean), '
        '"score" (0.0 to 1.0) and "issues" (array of strings).\n\n' + plan_section(plan)
    )


def score_requests(batched: DataFrame, plan: Plan, raw: str = "raw") -> DataFrame:
    """One request per batch: ``batch_id``, ``n_rows``, ``instructions`` and ``message``.

    The rows of a batch, at most ``batch_size``, become one JSON array in row order.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(raw).alias("raw"))))
    requests = batched.groupBy("batch_id").agg(F.count("*").alias("n_rows"), rows.alias("rows"))
    samples = F.array_join(F.transform("rows", lambda r: r["raw"]), ",")
    # Fixed value: the wording of the message.
    message = F.concat(
        F.lit("Validate the following "),
        F.col("n_rows").cast("string"),
        F.lit(
            " samples against the schema.\nFor each sample, return: "
            '{"index": int, "is_valid": bool, "score": float (0-1), "issues": [str]}.\n'
            "Return a JSON array.\n\nSamples:\n["
        ),
        samples,
        F.lit("]"),
    )
    return requests.select(
        "batch_id", "n_rows", F.lit(scoring_instructions(plan)).alias("instructions"), message.alias("message")
    )
