"""Connected components of links between numbers: alternating large and small stars, until one bounded task can finish."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import checkpointed

#: So many links at most are left to one task.
LAST_LINKS = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, in order, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _finish(table: pa.Table) -> pa.Table:
    nodes, roots = forest(table["u"].to_numpy(), table["v"].to_numpy())
    return pa.table({"node": nodes, "root": roots})


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour (or to itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these. Edges lead from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, last: int = LAST_LINKS) -> DataFrame:
    """(node, root) of each node that a link (u, v) of two different numbers touches; root is the least number it reaches.

    At most `last` links are resolved in one task. More take rounds that grow with the logarithm of the largest component,
    each checkpointed, until the stars don't change.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(now)
    if before[0] <= last:
        return now.groupBy(F.lit(0).alias("_all")).applyInArrow(_finish, "node bigint, root bigint")
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
