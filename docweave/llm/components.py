"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import stage

HELD = 1_000_000  # links that a task reduces to a forest at once
TASK = 100_000  # links for which it takes a task to reduce the forests of all others
SALTS = 8  # tasks over which the links of a hub are spread


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes: every node of a component with its least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def reduced() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate(side) for side in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n > HELD:
            yield reduced()
            held, n = [], 0
    if held:
        yield reduced()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with what its ``a`` is given; the edges of a hub come from several tasks."""
    spread = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, ["a", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with links; a component is named by its least node.

    Links are long ids; each task first reduces its own to a forest, and then as many tasks as
    their number asks for do so again, before what several tasks hold goes to rounds of stars.  Every
    round is written, so a lost executor costs its tasks only.  Rounds grow with the logarithm of the
    number of nodes.  Self-links and repeated links make no difference.
    """
    edges = edges.where("a <> b").select("a", "b")
    edges = stage(edges.mapInArrow(_forests, "a long, b long"))
    tasks = -(-edges.count() // TASK)
    edges = stage(edges.repartition(max(tasks, 1)).mapInArrow(_forests, "a long, b long"))
    while tasks > 1:
        edges = stage(_small_star(_large_star(edges.distinct())).where("a <> b").distinct())
        # Done when every node has one parent or is one.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        tied = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        if tied.where("up > 1 or (up = 1 and least = 0)").isEmpty():
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())
