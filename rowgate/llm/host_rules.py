"""Quality rules of documents and of their hosts, in DataFrame expressions alone.

Every document is measured (words, symbols, repeated lines, repeated runs of words) and held
against rules. Failures of every rule are counted per host; each host's failure rate is drawn
towards the rate of all hosts by a beta prior fitted to the hosts' rates (method of moments), so
a host with few documents is judged mildly. A host of ``LEAST_DOCUMENTS`` or more whose drawn-in rate of some rule reaches
``FACTOR`` times the rate of all documents (within the rule's bounds) is rejected, and the verdict is joined back: its
documents go, unless they fail no rule at all.

Defined results: null, empty and blank texts have no words and fail the base rule. A null host is a
host like any other. Repeated rows count as often as they occur. With one host, or hosts with
equal rates, the prior weighs like ``PRIOR_DOCUMENTS`` documents. An empty table gives no rows.
Columns of the input are not kept, so names cannot clash.

Scale: texts are read once by one pass without a shuffle, and what is measured (numbers and the
host) is staged. Host counts are summed on the map side first. Verdicts, one row per host, are
joined on the host by a plain join: broadcast by Spark where their measured size allows, else
a sort-merge join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import table

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
PRIOR_DOCUMENTS = 10.0
LEAST_WEIGHT = 2.0  # that of a uniform prior
# A host is rejected from this multiple of the rate of all hosts on, within the bounds of its rule: a rate below the
# first never rejects, one from the second on always does.
FACTOR = 4.0
HOST_LIMITS = {"few_words": (0.2, 0.5), "repeats": (0.2, 0.5), "symbols": (0.2, 0.5), "lines": (0.2, 0.5)}
LEAST_DOCUMENTS = 20  # of a host that is judged


def words_of(text: Column) -> Column:
    """Words between space and the controls from tab to carriage return."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _covered(places: Column) -> Column:
    """Words in windows that begin at these ascending places."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(WINDOW))).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per row.

    Windows are told apart by a 64-bit hash within one text. Arrays that a lambda looks into are columns of
    their own: as parts of the lambda they would be made again for every element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)))
    df = df.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW)))))
    # most texts repeat nothing, which a set of the hashes shows; only the others are sorted
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(twice, placed))
    equal = F.transform(
        "placed",
        lambda s, k: F.when((s["h"] == F.get("placed", k - 1)["h"]) | (s["h"] == F.get("placed", k + 1)["h"]), s["i"]),
    )
    places = F.sort_array(F.filter(equal, lambda i: i.isNotNull()))
    return df.select(
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(_covered(places), F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Failures of a measured row."""
    words = F.col("n_words")
    return {
        "few_words": words < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "lines": 10 * F.col("n_dup_lines") > words,
    }


BASE = ("few_words", "repeats")


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, rejected): from the rules' failures per host, drawn in by a beta prior.

    judged: host, and a BOOLEAN column per rule.
    """
    counts = [F.sum(F.col(r).cast("double")).alias(f"f_{r}") for r in HOST_LIMITS]
    hosts = judged.groupBy("host").agg(F.count("*").cast("double").alias("n"), *counts)
    of_all = []
    for r in HOST_LIMITS:
        rate = F.col(f"f_{r}") / F.col("n")
        of_all += [
            (F.sum(f"f_{r}") / F.sum("n")).alias(f"m_{r}"),
            F.var_samp(rate).alias(f"v_{r}"),
            F.avg(1 / F.col("n")).alias(f"i_{r}"),
        ]
    prior = hosts.agg(*of_all)
    joined = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one")  # of one row
    bad = F.lit(False)
    for r, (least, most) in HOST_LIMITS.items():
        m, spread = F.col(f"m_{r}"), F.col(f"m_{r}") * (1 - F.col(f"m_{r}"))
        # variance between hosts, without what chance adds to each rate
        between = F.col(f"v_{r}") - spread * F.col(f"i_{r}")
        weight = F.when(between > 0, F.greatest(spread / between - 1, F.lit(LEAST_WEIGHT))).otherwise(F.lit(PRIOR_DOCUMENTS))
        weight = F.least(F.coalesce(weight, F.lit(PRIOR_DOCUMENTS)), F.lit(1000.0))
        limit = F.least(F.greatest(FACTOR * m, F.lit(least)), F.lit(most))
        bad = bad | ((F.col(f"f_{r}") + weight * m) / (F.col("n") + weight) >= limit)
    return joined.select("host", (bad & (F.col("n") >= LEAST_DOCUMENTS)).alias("rejected"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures of each row with base_failed and kept."""
    checks = rules()
    measured = stage(measure(docs, host), "measured")
    judged = measured.withColumns(checks)
    hosts = host_verdicts(judged).withColumnRenamed("host", "of_host")
    joined = judged.join(hosts, judged["host"].eqNullSafe(hosts["of_host"]), "left")
    failed = F.col(BASE[0]) | F.col(BASE[1])
    some = F.lit(False)
    for r in checks:
        some = some | F.col(r)
    return joined.select(
        *measured.columns,
        failed.alias("base_failed"),
        (~failed & ~(F.coalesce("rejected", F.lit(False)) & some)).alias("kept"),
    )


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host")


_LIMITS_SQL = ", ".join(
    f"sum(f_{r}) / sum(n) AS m_{r}, var_samp(f_{r} / n) AS v_{r}, avg(1 / n) AS i_{r}" for r in HOST_LIMITS
)
_BAD_SQL = " OR ".join(
    f"(f_{r} + w_{r} * m_{r}) / (n + w_{r}) >= least(greatest({FACTOR} * m_{r}, {least}), {most})"
    for r, (least, most) in HOST_LIMITS.items()
)
_WEIGHT_SQL = ", ".join(
    f"least(coalesce(CASE WHEN v_{r} - m_{r} * (1 - m_{r}) * i_{r} > 0 "
    f"THEN greatest(m_{r} * (1 - m_{r}) / (v_{r} - m_{r} * (1 - m_{r}) * i_{r}) - 1, {LEAST_WEIGHT}) ELSE {PRIOR_DOCUMENTS} END, "
    f"{PRIOR_DOCUMENTS}), 1000.0) AS w_{r}"
    for r in HOST_LIMITS
)
OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d
), m AS (
  SELECT doc_id, source AS host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - list_unique(l) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), j AS (
  SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeats,
    10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > n_words AS lines
  FROM m
), h AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n,
    {", ".join(f"CAST(sum(CAST({r} AS INTEGER)) AS DOUBLE) AS f_{r}" for r in HOST_LIMITS)}
  FROM j GROUP BY host
), verdicts AS (
  SELECT host, ({_BAD_SQL}) AND n >= {LEAST_DOCUMENTS} AS rejected
  FROM (SELECT *, {_WEIGHT_SQL} FROM h, (SELECT {_LIMITS_SQL} FROM h))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
  NOT (few_words OR repeats) AND NOT (coalesce(rejected, false) AND ({" OR ".join(HOST_LIMITS)})) AS kept
FROM j LEFT JOIN verdicts ON j.host IS NOT DISTINCT FROM verdicts.host
"""
