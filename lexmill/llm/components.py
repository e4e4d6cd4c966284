"""Connected components by alternating large-star and small-star steps on DataFrames.

Each step is a grouped minimum, combined before its shuffle, and a join of the edges with it; no neighbour list is ever
gathered, so a node with a third of all edges is only a skewed join key, which adaptive execution splits. Every step's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.store import Scratch


def _around(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _least(near: DataFrame) -> DataFrame:
    """Of each node: the smallest node among it and its neighbours, and whether it is a centre or a tip of a star."""
    below = F.count(F.when(F.col("v") < F.col("u"), 1))
    star = (below == 0) | ((below == 1) & (F.count(F.lit(1)) == 1))
    return near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), star.alias("star"))


def _large(edges: DataFrame, least: DataFrame) -> DataFrame:
    both = _around(edges).join(least.select("u", "m"), "u").where(F.col("v") > F.col("u"))
    return both.select(F.col("m").alias("a"), F.col("v").alias("b")).where(F.col("a") < F.col("b")).distinct()


def _small(edges: DataFrame, least: DataFrame) -> DataFrame:
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.select("u", "m"), "u")
    moved = both.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(both.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where(F.col("a") < F.col("b")).distinct()


def connected(edges: DataFrame, scratch: Scratch, label: str, most_steps: int = 60) -> DataFrame:
    """(id, comp) of every node that has an edge: comp is the smallest id reachable.

    The steps end when every component is a star around its smallest node, which each step's minima tell by themselves.
    Minima are written, so that the joins' sides are plain shuffles and the edges of a node with very many can be split.
    """
    now = scratch.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct(), f"{label}_0")
    for step in range(1, most_steps + 1):
        least = scratch.cut(_least(_around(now)), f"{label}_{step}_large")
        if least.where(~F.col("star")).isEmpty():
            break
        wide = scratch.cut(_large(now, least), f"{label}_{step}_wide")
        lower = scratch.cut(_least(wide.select(F.col("b").alias("u"), F.col("a").alias("v"))), f"{label}_{step}_small")
        now = scratch.cut(_small(wide, lower), f"{label}_{step}")
        scratch.drop(f"{label}_{step - 1}", f"{label}_{step}_large", f"{label}_{step}_wide", f"{label}_{step}_small")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
