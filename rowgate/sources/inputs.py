"""Many inputs in one scan: which inputs a file belongs to, told by its path alone."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# Inputs of one scan. Their paths travel with each of its tasks, so beyond that another scan begins.
INPUTS_PER_SCAN = 100_000
_PATTERN = re.compile(r"[*?\[{]")
_PLAIN = re.compile(r"[A-Za-z0-9/:._=,+@-]*")


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Paths are listed by a task each, up to 10,000 tasks; listing a path takes less time than starting a task."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), max(32, 2 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


class InputGroup(NamedTuple):
    """Inputs that are scanned together: the paths to read, and the numbers of the inputs that have each root."""

    spark: SparkSession
    paths: list[str]
    roots: dict[str, list[int]]  # by their URIs, as rows name their files

    def scan(self, reader: DataFrameReader, value: Column, row: Column, block: Column | None = None) -> DataFrame:
        """(seq, input_ord, value): every row once for each input that its file belongs to.

        Files below a root belong to it if they are in its own folder or in partition folders (``day=1``), as Spark
        reads a folder. Folders of all roots are listed at once, by tasks if there are many.
        """
        with _few_listing_tasks(self.spark):
            read = reader.option("recursiveFileLookup", "true").load(self.paths)
        block = F.col("_metadata.file_block_start") if block is None else block
        of_inputs = self.inputs_of(F.col("_metadata.file_path"))
        rows = read.select(
            of_inputs.alias("__inputs"), F.col("_metadata.file_path").alias("__file"), block.alias("__block"), row.alias("__row"), value
        )
        # a file of no input (in a folder that is no partition) has no input to be unfolded for
        rows = rows.withColumn("input_ord", F.explode("__inputs"))
        seq = F.struct(
            F.col("input_ord").alias("input"),
            F.col("__file").alias("file"),
            F.col("__block").cast("bigint").alias("block"),
            F.col("__row").cast("bigint").alias("row"),
        )
        return rows.select(seq.alias("seq"), "input_ord", *rows.columns[4:-1])

    def inputs_of(self, path: Column) -> Column:
        """The numbers of the inputs that a file belongs to, as an expression over its path.

        The roots are one literal, a hash table: an array of small maps, found by the CRC-32 of a root. A path is
        looked up once for each depth that roots have.
        """
        size = max(1, len(self.roots))
        cells: list[dict[str, list[int]]] = [{} for _ in range(size)]
        for root, numbers in self.roots.items():
            cells[zlib.crc32(root.encode()) % size][root] = numbers
        # JSON text of a literal is folded into one literal of the table, however many roots there are
        table = F.from_json(F.lit(json.dumps(cells, ensure_ascii=False)), "array<map<string,array<int>>>")
        none = F.array().cast("array<int>")
        depth_of = F.length(path) - F.length(F.translate(path, "/", ""))
        found = []
        for depth in sorted({root.count("/") for root in self.roots}):
            root = F.substring_index(path, "/", depth + 1)
            inside = F.substr(path, F.length(root) + 2, F.length(path))
            # a file itself, or in the root's folder, below partition folders at most
            belongs = (root == path) | ~inside.contains("/") | inside.rlike("^([^/=]+=[^/]*/)*[^/]+$")
            cell = F.get(table, F.pmod(F.crc32(root.cast("binary")), F.lit(size)).cast("int"))
            found.append(F.when((depth_of >= depth) & belongs, F.coalesce(F.try_element_at(cell, root), none)).otherwise(none))
        return found[0] if len(found) == 1 else F.flatten(F.array(*found))


def _roots(spark: SparkSession, path: str, qualify) -> list[str]:
    """The files or folders that a path or pattern names, as the scan will name them."""
    if not _PATTERN.search(path):
        return [qualify(path)]
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in system.globStatus(made) or []]


def _qualifier(spark: SparkSession):
    """Qualify paths; a path that says all by itself costs no call."""
    known: dict[str, str] = {}

    def qualify(path: str) -> str:
        head, _, name = path.rstrip("/").rpartition("/")
        if not head or name in ("", ".", ".."):
            return _made(spark, path)
        if head not in known:
            known[head] = _made(spark, head + "/x")[:-2]
        return f"{known[head]}/{name}"

    return qualify


def _made(spark: SparkSession, path: str) -> str:
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()


def _uri(spark: SparkSession, root: str) -> str:
    """A path with what is no part of a URI escaped; most paths need no call for that."""
    return root if _PLAIN.fullmatch(root) else spark._jvm.org.apache.hadoop.fs.Path(root).toUri().toString()


def _listed_by(root: str, roots: dict[str, list[int]]) -> bool:
    """Whether listing a folder above ``root``, itself a root, lists it too: hidden folders aren't listed."""
    parts = root.split("/")
    for k in range(len(parts) - 1, 0, -1):
        if parts[k][:1] in ("_", ".") and "=" not in parts[k]:
            return False
        if "/".join(parts[:k]) in roots:
            return True
    return False


def input_groups(spark: SparkSession, inputs: Sequence[str], numbers: Sequence[int] | None = None) -> list[InputGroup]:
    """The inputs dealt into groups, most often one; a file that several of them name is read once in a group."""
    qualify, groups = _qualifier(spark), []
    numbered = list(zip(inputs, numbers if numbers is not None else range(len(inputs))))
    for at in range(0, max(1, len(numbered)), INPUTS_PER_SCAN):
        roots: dict[str, list[int]] = {}
        unknown = []  # patterns that name nothing; the scan says so
        for path, number in numbered[at : at + INPUTS_PER_SCAN]:
            named = _roots(spark, path, qualify)
            unknown += [] if named else [path]
            for root in named:
                roots.setdefault(root, []).append(number)
        read = [re.sub(r"([*?\[\]{}\\])", r"\\\1", root) for root in roots if not _listed_by(root, roots)]
        groups.append(InputGroup(spark, read + unknown, {_uri(spark, root): of for root, of in roots.items()}))
    return groups
