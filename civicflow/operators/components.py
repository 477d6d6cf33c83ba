"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.storage import cut, dropped


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written, so that the join below reads both sides from shuffles of its own, which adaptive
    # execution can split at a node with very many neighbours.
    least = cut(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    met = near.join(least, F.col("u") == F.col("w"))
    if small:
        linked = met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b")))
    else:
        linked = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    done = cut(linked.distinct(), "edges")
    dropped(least)
    return done


def _settled(edges: DataFrame) -> bool:
    """Do the edges (a, b) form stars: each a has one b, and no b is an a?"""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not per.agg(F.count_if((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1)))).first()[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge table (a, b) of longs; root is the least node reachable.

    Self-links and repeated links are harmless; an empty table gives an empty one. Each round is
    written to shared storage, and the round before is removed. A round takes a chain of n links to
    about its logarithm. Links that are stars already take no round.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        large = _star(now, small=False)
        small = _star(large, small=True)
        dropped(now, large)
        now = small
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
