"""Joins against sides of a checked size, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.storage import staged

#: A staged side of up to so many rows (or list items) of a few numbers each is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def with_small(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", items: Column | None = None) -> DataFrame:
    """Join a staged ``small`` side of narrow rows: broadcast if it is within the bound, else by shuffle.

    ``items`` counts the list items of a row, for a side with lists.
    """
    size = small.agg(F.count("*") if items is None else F.count("*") + F.coalesce(F.sum(items), F.lit(0))).first()[0]
    return big.join(F.broadcast(small) if size <= BROADCAST_ROWS else small, on, how)


def _lowest(pairs: DataFrame) -> DataFrame:
    """Add the least neighbour ``m`` of each ``u``. The grouped side is staged, so a hub's rows can be split over tasks."""
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.join(least, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (u, v) points to one node at most, and to none if another points to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), component being the least node.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until only stars are left: edges that
    are stars from the start take no step. Nodes without edges don't appear; repeated edges and loops don't matter.
    """
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(current):
        both = current.union(current.select("v", "u").toDF("u", "v"))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = staged(large)
        small = _lowest(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = staged(small.union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct())
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
