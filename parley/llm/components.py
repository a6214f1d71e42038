"""Connected components: a vectorised local form and a distributed one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def local_roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Root (smallest index) of each of n nodes under links i-j, added to an earlier forest."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def distributed_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (src, dst) -> (node, root): every linked node but the roots, with the smallest node it reaches.

    Alternating large-star and small-star steps; each step only groups with
    partial aggregation and joins on a unique side, so a hub with most of the
    nodes is split by adaptive skew joins. The forest is written after each round.
    Empty edges give an empty result; self links and repeated links change nothing.
    """
    e = scratch.keep(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _is_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_forest(e: DataFrame) -> bool:
    """Whether each node has one parent and no parent has a parent."""
    if not e.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
