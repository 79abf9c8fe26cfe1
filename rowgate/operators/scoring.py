"""Run a user-supplied scorer over requests, and repair answers that do not parse."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_file_system, qualified, stage, staging_path
from .responses import repair_message, with_samples, with_verdicts

# Called once per task (and thread); the result takes the messages (dicts of role and content) of one
# request and returns the answer text.
ScorerFactory = Callable[[], Callable[[list[dict[str, str]]], str]]

# Requests are dealt over so many folders of the journal, each of which one task reads and writes.
JOURNAL_FOLDERS = 256


class Journal:
    """Answers by the hash of their request: files of one JSON line per answer, never changed once written.

    A file is written for each group of calls under a name of its own, so tasks that run twice do not meet. A line that
    a lost task left half written is no answer.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def read(self, number: int) -> dict[str, str]:
        system, place = arrow_file_system(f"{self.folder}/{number}")
        answers: dict[str, str] = {}
        for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            with system.open_input_stream(info.path, compression=None) as stream:
                lines = stream.read().decode("utf-8", "replace").split("\n")
            for line in lines[:-1]:
                try:
                    request, answer = json.loads(line)
                except ValueError:
                    continue
                answers.setdefault(request, answer)
        return answers

    def write(self, number: int, answers: list[tuple[str, str]]) -> None:
        if not answers:
            return
        system, place = arrow_file_system(f"{self.folder}/{number}/{uuid.uuid4().hex}")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place, compression=None) as out:
            out.write("".join(json.dumps(pair) + "\n" for pair in answers).encode())


def _request(keys: tuple[str, ...]) -> Column:
    """A hash of what is asked and of the batch it is asked for."""
    return F.sha2(F.to_json(F.struct(*keys, "messages")), 256)


def _caller(make_scorer: ScorerFactory, journal: str, in_flight: int, group: int):
    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers, log, known = threading.local(), Journal(journal), {}

        def answer(messages: list[dict[str, str]]) -> tuple[str | None, str | None]:
            try:
                if not hasattr(scorers, "own"):
                    scorers.own = make_scorer()
                return scorers.own(messages), None
            except Exception as problem:  # an error is data here; it must not end the job
                return None, f"{type(problem).__name__}: {problem}"

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                asked = [[dict(m) for m in messages] for messages in frame["messages"]]
                hashes, folders = frame["__request"].tolist(), frame["__folder"].tolist()
                for folder in set(folders) - known.keys():
                    known[folder] = log.read(folder)
                done = [(known[f][h], None) if h in known[f] else None for f, h in zip(folders, hashes)]
                missing = [i for i, found in enumerate(done) if found is None]
                for at in range(0, len(missing), group):
                    part = missing[at : at + group]
                    for i, found in zip(part, pool.map(answer, [asked[i] for i in part])):
                        done[i] = found
                    for folder in {folders[i] for i in part}:
                        fresh = [(hashes[i], done[i][0]) for i in part if folders[i] == folder and done[i][1] is None]
                        log.write(folder, fresh)
                texts, errors = ([found[k] for found in done] for k in (0, 1))
                answered = frame.drop(columns=["__request", "__folder"])
                yield answered.assign(text=pd.Series(texts, dtype="object"), scorer_error=pd.Series(errors, dtype="object"))

    return call


def run_scorer(
    requests: DataFrame,
    make_scorer: ScorerFactory,
    *,
    expect: str = "verdicts",
    max_calls: int = 3,
    keys: tuple[str, ...] = ("batch_id",),
    partitions: int | None = None,
    in_flight: int = 1,
    group: int = 16,
    journal: str | None = None,
) -> DataFrame:
    """Answers to ``requests`` (``instructions``, ``message``) from a user-supplied scorer.

    Returns the keys, ``text``, ``attempts``, ``error`` and ``scorer_error``. Each round is
    one ``mapInPandas`` over all open requests, staged at once, so that neither a replan nor
    a lost executor calls the scorer again for finished rounds. Answers that do not parse go
    into the next round with a repair message; an exception of the scorer is final.

    Within a round each answer is logged in a journal after every ``group`` calls, and a task looks there before it
    calls: one that is repeated calls the scorer only for what was not logged, at most ``group`` calls again. ``journal``
    names a folder that all executors share; then a later run over the same requests begins where this one ended. Exceptions
    are not logged.

    ``partitions`` is the number of tasks that call the scorer at a time, else as many as the session has cores, and never over
    ``JOURNAL_FOLDERS``; ``in_flight`` is the number of calls that a task has open at a time, each from a thread with a scorer of its own.
    """
    parse = {"verdicts": with_verdicts, "samples": with_samples}[expect]
    found = "verdicts" if expect == "verdicts" else "elements"
    message = F.array(
        F.struct(F.lit("system").alias("role"), F.col("instructions").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("message").alias("content")),
    )
    spark = requests.sparkSession
    folder = qualified(spark, journal) if journal is not None else staging_path(spark, "journal")
    pending = requests.select(*keys, message.alias("messages"))
    answer_schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in pending.schema.fields
    ) + ", text string, scorer_error string"
    finished = []
    for attempt in range(1, max_calls + 1):
        # requests of a folder are one task's, whatever the number of tasks
        dealt = pending.withColumn("__request", _request(keys)).withColumn("__folder", F.pmod(F.crc32("__request"), F.lit(JOURNAL_FOLDERS)).cast("int"))
        dealt = dealt.repartition(partitions or spark.sparkContext.defaultParallelism, "__folder")
        caller = _caller(make_scorer, folder.rstrip("/"), in_flight, group)
        answered = stage(dealt.mapInPandas(caller, answer_schema), f"answers-{attempt}")
        checked = parse(answered).drop(found).withColumn("attempts", F.lit(attempt))
        checked = checked.withColumn(
            "error", F.when(F.col("scorer_error").isNotNull(), F.col("scorer_error")).otherwise(F.col("error"))
        )
        retry = F.col("error").isNotNull() & F.col("scorer_error").isNull()
        if attempt == max_calls:
            finished.append(checked)
            break
        finished.append(checked.where(~retry))
        repair = F.array(
            F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")),
            F.struct(F.lit("user").alias("role"), repair_message(F.col("error")).alias("content")),
        )
        again = checked.where(retry)
        if again.isEmpty():
            break
        pending = again.select(*keys, F.concat("messages", repair).alias("messages"))
    columns = [*keys, "text", "attempts", "error", "scorer_error"]
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in finished])
