"""Connected components of an edge table, distributed: alternating large-star and small-star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round aggregates minima (combined before the shuffle) and joins them back, so a hub
    is never gathered into one task. The edges shrink to stars around the minima; the state is
    checkpointed in the shared folder after each round. Edges with a null end are ignored, loops
    add nothing, and an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut_lineage(e.where("u is not null and v is not null and u != v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return e.union(e.select("v", "v")).distinct().toDF("node", "component")


def _stars(e: DataFrame) -> bool:
    """Every node either hangs on exactly one root or is a root."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("x").agg(F.sum("out").alias("o"), F.sum("in").alias("i"))
    return sums.where("o > 1 or (o > 0 and i > 0)").isEmpty()


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of n local nodes under the links (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while not np.array_equal(label[label], label):
        label = label[label]
    return label
