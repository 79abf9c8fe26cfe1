"""Reports on checked and generated rows: issues, overlap of chunks, axes, sources, policy."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_column
from ..functions.values import VariantValue
from ..plans import Axis
from .batches import running_total

# What differs from row to row in the text of an issue: quoted values, lists, numbers.
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_LIST = r"\[.*\]"
_FIELD = r"(?s)^(missing required field|unexpected field) ['\"](.*)['\"]$"
_NUMBER = r"-?[0-9][0-9.]*(?:e[+-]?[0-9]+)?"


def issue_profile(checked: DataFrame, issues: str = "issues") -> DataFrame:
    """(code, path, n): how often each kind of issue occurs at each place of the schema.

    The code is the issue's text with its values left out, the path is without array
    indexes; both come from the row itself, so counts are summed per task before a shuffle.
    """
    issue = F.col("issue")
    placed = issue.rlike(r"(?s)^\$[^:]*: ")
    path = F.when(placed, F.regexp_extract(issue, r"(?s)^(\$[^:]*): ", 1)).otherwise("")
    text = F.when(placed, F.regexp_replace(issue, r"(?s)^\$[^:]*: ", "")).otherwise(issue)
    # a field that is missing or too much is part of the place
    about_field = placed & text.rlike(_FIELD)
    path = F.when(about_field, F.concat_ws(".", path, F.regexp_extract(text, _FIELD, 2))).otherwise(path)
    text = F.when(about_field, F.regexp_extract(text, _FIELD, 1)).otherwise(text)
    for pattern in (_QUOTED, _LIST, _NUMBER):
        text = F.regexp_replace(text, f"(?s){pattern}", "?")
    single = checked.select(F.explode(issues).alias("issue"))
    named = single.select(text.alias("code"), F.regexp_replace(path, r"\[[0-9]+\]", "[]").alias("path"))
    return named.groupBy("code", "path").agg(F.count("*").alias("n"))


def chunk_overlap(rows: DataFrame, chunk: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """(first_chunk, chunk, duplicates): copies in ``chunk`` of rows that ``first_chunk`` had first.

    Rows of a key are first counted per chunk, which leaves one row per key and chunk; each is then
    set against the chunk of the key's first row. So a text that many rows share costs as many
    rows as it has chunks, not pairs. A NULL chunk is a chunk like others; rows without a key are left out.
    """
    counted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(chunk).alias("chunk"))
    counted = counted.agg(F.count("*").alias("__n"), F.min(seq).alias("__at"))
    firsts = counted.groupBy("__key").agg(F.min(F.struct("__at", F.col("chunk").alias("of"))).alias("__first"))
    placed = counted.join(firsts, "__key").withColumn("first_chunk", F.col("__first.of"))
    own = F.when(F.col("__at") == F.col("__first.__at"), 1).otherwise(0)
    copies = placed.groupBy("first_chunk", "chunk").agg(F.sum(F.col("__n") - own).cast("bigint").alias("duplicates"))
    return copies.where("duplicates > 0")


def chunk_pairs(rows: DataFrame, chunk: str, key: str = "key", share: float = 1.0) -> DataFrame:
    """(chunk, other, keys, other_keys, shared, containment, jaccard, error): every two chunks that share a key.

    ``keys``, ``other_keys`` and ``shared`` count distinct keys; ``containment`` is the shared part of the smaller chunk. The
    chunk that is less comes first, a NULL chunk before all others; rows without a key are left out. Keys are first grouped by
    the set of chunks that have them: a key that many rows share costs one entry per chunk, and all keys of one set together cost
    that set's pairs once.

    With ``share`` below 1 only keys are compared whose hash is in that part of all hashes, the same for every chunk. Counts
    are then estimates: ``shared`` is within twice ``error``, its standard error, in 19 of 20 cases, and pairs that share fewer
    keys than 1 in ``share`` may be missing.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    held = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.struct(F.col(chunk).alias("c")).alias("__chunk"))
    if share < 1:
        held = held.where(F.pmod(F.xxhash64("__key"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sets = held.groupBy("__key").agg(F.array_sort(F.collect_set("__chunk")).alias("__set"))
    counted = sets.groupBy("__set").agg(F.count("*").alias("__n"))
    ones = counted.select(F.explode("__set").alias("__one"), "__n").groupBy("__one").agg(F.sum("__n").alias("__keys"))
    placed = counted.select(F.posexplode("__set").alias("__at", "__one"), "__set", "__n")
    later = F.slice("__set", F.col("__at") + 2, F.size("__set") - F.col("__at") - 1)
    pairs = placed.where(F.col("__at") < F.size("__set") - 1).select("__one", F.explode(later).alias("__two"), "__n")
    shared = pairs.groupBy("__one", "__two").agg(F.sum("__n").alias("__shared"))
    # a struct with a NULL chunk is equal to another one
    both = shared.join(ones, "__one").join(ones.select(F.col("__one").alias("__two"), F.col("__keys").alias("__other_keys")), "__two")
    whole = [F.round(F.col(c) / share).cast("bigint") for c in ("__keys", "__other_keys", "__shared")]
    smaller = F.least("__keys", "__other_keys")
    return both.select(
        F.col("__one.c").alias("chunk"),
        F.col("__two.c").alias("other"),
        whole[0].alias("keys"),
        whole[1].alias("other_keys"),
        whole[2].alias("shared"),
        (F.col("__shared") / smaller).alias("containment"),
        (F.col("__shared") / (F.col("__keys") + F.col("__other_keys") - F.col("__shared"))).alias("jaccard"),
        (F.sqrt(F.col("__shared") * (1 - share)) / share).alias("error"),
    )


def _axis_value(rows: DataFrame, name: str, value: str | None) -> Column:
    """The row's value on an axis as text: from VARIANT ``value``, or from the column of that name."""
    if value is None:
        return F.col(quote_column(name)).cast("string")
    return F.expr(VariantValue(value).child(name)[1].get("string"))


def axis_coverage(rows: DataFrame, axes: Sequence[Axis], value: str | None = "v") -> DataFrame:
    """(axis, value, declared, n, share, target_share, gap) for the values of every axis.

    Declared values that no row has are listed with 0; values that are not declared, and NULL for
    rows without one, are listed too. Rows are read once for all axes. ``target_share`` and ``gap`` are NULL on
    axes without shares and for values that aren't declared.
    """
    if not axes:
        raise ValueError("the plan has no axis")
    pairs = [F.struct(F.lit(a.name).alias("axis"), _axis_value(rows, a.name, value).alias("value")) for a in axes]
    seen = rows.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))
    declared = []
    for axis in axes:
        shares = axis.target_shares() or {}
        declared += [(axis.name, v, True, shares.get(v)) for v in dict.fromkeys(axis.values)]
    schema = "axis string, value string, declared boolean, target_share double"
    wanted = rows.sparkSession.createDataFrame(declared, schema).withColumn("n", F.lit(0).cast("bigint"))
    seen = seen.select("axis", "value", F.lit(False).alias("declared"), F.lit(None).cast("double").alias("target_share"), "n")
    counted = seen.unionByName(wanted).groupBy("axis", "value").agg(
        F.max("declared").alias("declared"), F.max("target_share").alias("target_share"), F.sum("n").alias("n")
    )
    totals = counted.groupBy("axis").agg(F.sum("n").alias("__total"))
    # one row per axis of the plan
    shared = counted.join(F.broadcast(totals), "axis").withColumn("share", F.try_divide("n", "__total"))
    return shared.select(
        "axis", "value", "declared", "n", "share", "target_share", (F.col("share") - F.col("target_share")).alias("gap")
    )


# The longest period after which shares come out whole.
MOST_PERIOD = 10_000


def quota_order(shares: Sequence[float]) -> tuple[list[int], list[int]]:
    """The value of each row of a period, by number, and how many rows of the period each value gets.

    The period is the least number of rows in which every share is whole. Row by row, of the values whose share of the rows so
    far allows one more, that comes whose next one is due first, of equal ones the first: so after any number of rows each value
    has its share rounded down or up.
    """
    exact = [Fraction(repr(float(share))) for share in shares]
    whole = [share / sum(exact) for share in exact]
    period = math.lcm(*(share.denominator for share in whole))
    if period > MOST_PERIOD:
        raise ValueError(f"shares {list(shares)} are whole for no number of rows up to {MOST_PERIOD}")
    rows, given, order = [int(share * period) for share in whole], [0] * len(whole), []
    for row in range(period):
        open_values = [k for k, n in enumerate(rows) if given[k] * period < n * (row + 1)]
        order.append(min(open_values, key=lambda k: -(-(given[k] + 1) * period // rows[k])))
        given[order[-1]] += 1
    return order, rows


def _quota(first: Column, order: list[int], rows: list[int], value: int) -> Column:
    """How many of the first rows of a run a value has."""
    before = [0]
    for chosen in order[:-1]:
        before.append(before[-1] + (chosen == value))
    counts = F.from_json(F.lit(json.dumps(before)), "array<bigint>")  # one literal
    period = F.lit(len(order)).cast("bigint")
    return F.call_function("div", first, period) * rows[value] + F.get(counts, F.pmod(first, period).cast("int"))


def batch_targets(
    batches: DataFrame,
    axes: Sequence[Axis],
    size: str = "n_rows",
    order: Sequence[str] | None = None,
    per: Sequence[str] = (),
    before: str | None = None,
) -> DataFrame:
    """One row (..., axis, value, count) per batch and value that the batch should have.

    With ``order`` the batches are one run. Its rows, in that order, are dealt to an axis's values by their shares (even shares if it
    has none) such that after any number of batches a value has its share of the rows so far, rounded down or up;
    a batch gets the rows between its ends. So the run as a whole keeps to the plan, however small its batches are. Values that
    get none are left out. With ``per`` each group of these columns is a run of its own. ``before`` names a column with the
    number of rows before the batch, if there is one; else it is summed up.

    Without ``order`` each batch is dealt by itself: what rounding leaves goes to the largest remainders, of equal ones to the
    value named first, the same way in every batch.
    """
    if order is None and before is None:
        return _each_by_itself(batches, axes, size)
    wanted = []
    for axis in axes:
        values = list(dict.fromkeys(axis.values))
        shares = axis.target_shares() or {v: 1 for v in values}
        if values:
            wanted.append((axis.name, values, *quota_order([shares[v] for v in values])))
    if not wanted:
        raise ValueError("no axis of the plan has values")
    at = before or "__before"
    rows = batches if before else running_total(batches, order or (), size, at, per)
    ends = F.col(at).cast("bigint"), F.col(at).cast("bigint") + F.col(size).cast("bigint")
    parts = []
    for name, values, in_order, counts in wanted:
        for k, value in enumerate(values):
            low, high = (_quota(end, in_order, counts, k) for end in ends)
            parts.append(F.struct(F.lit(name).alias("axis"), F.lit(value).alias("value"), (high - low).alias("count")))
    dealt = rows.withColumn("__part", F.explode(F.filter(F.array(*parts), lambda p: p["count"] > 0)))
    return dealt.select(*batches.columns, *(F.col(f"__part.{c}").alias(c) for c in ("axis", "value", "count")))


def _each_by_itself(batches: DataFrame, axes: Sequence[Axis], size: str) -> DataFrame:
    """Targets that round within each batch."""
    wanted = []
    for axis in axes:
        values = list(dict.fromkeys(axis.values))
        shares = axis.target_shares() or {v: 1.0 / len(values) for v in values}
        parts = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("value"), F.lit(shares[v]).alias("share")) for k, v in enumerate(values)]
        if parts:
            wanted.append(F.struct(F.lit(axis.name).alias("axis"), F.array(*parts).alias("parts")))
    if not wanted:
        raise ValueError("no axis of the plan has values")
    rows = batches.withColumn("__axis", F.explode(F.array(*wanted)))
    exact = F.col(size).cast("double")
    # a share that is a whole number but for the last bits of a double counts as whole
    whole = lambda p: F.floor(exact * p["share"] + 1e-9)
    dealt = rows.withColumn(
        "__dealt",
        F.array_sort(
            F.transform(
                "__axis.parts",
                lambda p: F.struct(
                    F.round(whole(p) - exact * p["share"], 9).alias("less"), p["k"].alias("k"), whole(p).alias("n"), p["value"].alias("value")
                ),
            )
        ),
    )
    given = F.aggregate("__dealt", F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
    dealt = dealt.withColumn("__left", F.col(size).cast("bigint") - given)
    parts = F.transform(
        "__dealt",
        lambda p, i: F.struct(p["value"].alias("value"), (p["n"] + F.when(i < F.col("__left"), 1).otherwise(0)).cast("bigint").alias("count")),
    )
    dealt = dealt.withColumn("__part", F.explode(F.filter(parts, lambda p: p["count"] > 0)))
    return dealt.select(*batches.columns, F.col("__axis.axis").alias("axis"), F.col("__part.value").alias("value"), F.col("__part.count").alias("count"))


def source_repeats(rows: DataFrame, source: str, most_per_100: float, seq: str = "seq") -> DataFrame:
    """(source_hash, n, first_seq, over): sources of more than one row, and whether they pass the limit.

    ``over`` is true where a source has more than ``most_per_100`` of every hundred rows. Only hashes
    and counts are shuffled. A NULL source is no source, but its rows count in the total.
    """
    text = F.col(quote_column(source))
    hashed = rows.groupBy(F.sha2(text.cast("binary"), 256).alias("source_hash"))
    counted = hashed.agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    total = rows.agg(F.count("*").alias("__total")).withColumn("__one", F.lit(1))
    repeated = counted.where("n > 1 AND source_hash IS NOT NULL").withColumn("__one", F.lit(1))
    both = repeated.join(F.broadcast(total), "__one")  # of one row
    return both.select("source_hash", "n", "first_seq", (F.col("n") * 100 > F.lit(float(most_per_100)) * F.col("__total")).alias("over"))


def policy_filter(rows: DataFrame, flags: DataFrame, disallowed: Sequence[str], on: str, category: str = "category") -> DataFrame:
    """``rows`` without those that have a flag of a disallowed category.

    ``flags`` has ``on`` and ``category``, any number of rows per row. A row with a NULL in ``on`` has no flags.
    """
    named = flags.where(F.col(category).isin(list(disallowed))) if disallowed else flags.limit(0)
    return rows.join(named.select(on).distinct(), on, "left_anti")
