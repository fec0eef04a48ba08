"""Connected components by alternating stars, with a written table after each round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def local_stars(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges u-v among n local nodes: each linked node and the smallest node it reaches (but for that node itself)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            own = np.flatnonzero(label != np.arange(n))
            return own, label[own]
        label = new


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) to (node, component): the smallest node each node reaches. Nodes without an edge are not in it.

    A round hangs the larger neighbours of each node, then the smaller ones, on the smallest neighbour: the number of rows
    doesn't grow, and the number of rounds follows the logarithm of the longest path."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen = digest(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if (got := digest(now)) == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
