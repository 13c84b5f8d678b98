"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task unites in memory (about 200 MB); larger graphs are contracted round by round.
ONE_TASK = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of a node is moved to the least of its neighbourhood. Small: the lesser ones and the node itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("u"))
    moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root (the least node reachable) of every node on an edge; edges: a, b. Each round is written to folder."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "root"])

    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/cc0")
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(unite, "node long, root long")
    seen, turn = None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen, turn = mark, turn + 1
        now = cut(_star(_star(now, True), False), f"{folder}/cc{turn}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
