"""Merge chunk files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.json_text import with_parsed
from ..functions.text import strip
from ..operators.merge import key_of, mark_first, with_status
from ..operators.validate import is_valid, validate_rows
from ..plans import Plan, Profile
from ..session import staged
from .membership import candidates, key_runs, merge_runs, seen_keys, write_run


def read_arriving_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines as they land in ``folder``, with the file and place of each line."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        strip(F.col("value")).alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def merge_batch(
    arrived: DataFrame,
    batch_id: int,
    state: str,
    output: str,
    plan: Plan | None = None,
    profiles: dict[str, Profile] | None = None,
) -> None:
    """Merge one micro-batch against the keys accepted before it.

    Rows go to ``output/batch=N``, newly accepted keys to a run of their own in ``state`` (see ``membership``). A
    replay overwrites both and looks only at keys of earlier batches, so it repeats the same result. Of the old keys only
    buckets are read that may hold a key of the batch. What the batch staged is deleted at its end.
    """
    spark = arrived.sparkSession
    merge_runs(spark, state, batch_id)
    rows = with_parsed(arrived.where("raw <> ''"), "raw", "v")
    checked = validate_rows(rows, plan, profiles=profiles)
    checked = checked.withColumn("key", F.when(is_valid(), key_of())).drop("v")
    order = F.struct("file", "block_start", F.monotonically_increasing_id())
    with staged(checked.withColumn("seq", order), "arrived") as checked:
        runs = key_runs(spark, state, batch_id)
        fresh = checked.where("key IS NOT NULL").select("key").distinct()
        with staged(candidates(fresh, runs), "candidates") as found:
            write_merged(mark_first(checked), seen_keys(found, runs), f"{output}/batch={batch_id}")
    written = spark.read.parquet(f"{output}/batch={batch_id}")
    write_run(spark, state, batch_id, batch_id, written.where("status = 'accepted'").select("key"))


def write_merged(firsts: DataFrame, seen: DataFrame | None, path: str) -> None:
    """Write rows with their status; the first row of a key that was seen before is a duplicate too."""
    if seen is not None:
        # only the first row of a key is looked up, so a hot key is one row here
        lookup = F.when(F.col("is_first"), F.col("key")).otherwise(F.unhex(F.sha2(F.to_json("seq"), 256)))
        known = seen.select(F.col("key").alias("__lookup"), F.lit(True).alias("__seen"))
        later = F.col("is_first") & F.coalesce("__seen", F.lit(False))
        firsts = (
            firsts.withColumn("__lookup", lookup)
            .join(known, "__lookup", "left")
            .withColumn("is_first", F.when(later, F.lit(False)).otherwise(F.col("is_first")))
            .drop("__lookup", "__seen")
        )
    with_status(firsts).write.mode("overwrite").parquet(path)


def merge_arrivals(
    spark: SparkSession,
    folder: str,
    state: str,
    output: str,
    checkpoint: str,
    plan: Plan | None = None,
    *,
    profiles: dict[str, Profile] | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start a query that merges all files now in ``folder`` and then stops.

    Start it again, with the same ``checkpoint``, for files that came later. Unlike a
    streaming ``dropDuplicates`` this keeps the duplicates and the invalid rows.
    """
    return (
        read_arriving_lines(spark, folder, files_per_batch)
        .writeStream.foreachBatch(
            lambda arrived, batch_id: merge_batch(arrived, batch_id, state, output, plan, profiles)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
