"""Connected components of an edge table: alternating large and small stars while it is large, one union by find once it is not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_keys, join_hot, written

#: Edges that one task joins at most: 16 bytes each, and about 200 in its tables.
ONE_TASK = 200_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with the m of their a; centres of large stars go by broadcast."""
    hot, _ = hot_keys(least, "a")
    return join_hot(edges, least.select("a", "m"), "a", hot, "inner")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both, least).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    linked = _with_least(down, down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
    return linked.select(pairs.alias("p")).select("p.a", "p.b").where("a != b").distinct()


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the edges, the smallest node that each reaches)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # a root is smaller than what hangs on it
        root[x] = root[root[x]]
    return nodes, nodes[np.array(root, np.int64)] if len(nodes) else nodes


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if held:
        nodes, least = united(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """edges (a, b: long) to (node, component): the smallest node that each linked node can reach.

    Up to ``one_task`` edges are joined by one task.  More go through star
    rounds: both star steps keep the components, and the number of rounds grows with
    the logarithm of the longest chain.  Each round is written to the shared
    folder, so lineage stays short and a lost executor repeats one round at
    most, and the round before it is deleted; only counts and sums per round reach the driver.
    """
    now = written(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    before = None
    for _ in range(most_rounds):
        # a sum over hashes tells whether the set of edges is still changing
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] <= one_task:
            return now.repartition(1).mapInArrow(_unite, "node long, component long")
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        made = written(_small_star(_large_star(now)), "edges")
        forget(now)
        before, now = state, made
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
