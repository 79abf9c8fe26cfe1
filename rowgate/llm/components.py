"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

# Nodes that one pass of a task holds before it hands its stars on.
HELD_NODES = 1_000_000


def stars(edges) -> tuple[list, list]:
    """(node, smallest node of its component) within the given edges, for nodes that aren't the smallest."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if parent[up] != up else up
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    nodes = [(x, root(x)) for x in list(parent)]
    return [x for x, r in nodes if x != r], [r for x, r in nodes if x != r]


def _contracted(edges: DataFrame) -> DataFrame:
    """Every partition's edges as stars: same components, never more edges."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held = []
        for batch in batches:
            held += zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())
            if len(held) >= HELD_NODES:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(held)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(held)], schema=schema)

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for all nodes that are not their root.

    edges: BIGINT columns u and v. Alternates large and small stars, which shrink the depth of
    each component by a constant factor a round, and stages each round; only counts come to the
    driver. Aggregates have a map-side step; the rows of a hub are joined by a plain equi-join,
    whose large partitions adaptive execution splits. Self-loops and repeated edges are fine.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = stage(_contracted(down).distinct(), "stars")
    before = _digest(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)), "stars")
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
