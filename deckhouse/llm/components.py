"""Connected components by alternating large and small stars, on stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, unstore


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return _distinct(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them; edges point down, u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = edges.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: every node of ``edges(u, v)`` and the smallest node reachable from it.

    Each step is stored, so lost executors cost one step. A hub is only ever a join key (AQE splits
    it) or a group of a minimum (partially aggregated). The steps needed grow with the logarithm
    of the longest path. Nodes that are their own label are not listed.
    """
    down = F.least("u", "v").alias("v")
    now = store(_distinct(edges.select(F.greatest("u", "v").alias("u"), down)), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if mark == seen or not mark.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen, before = mark, now
        now = store(_small(_large(now)), "edges")
        unstore(before)
