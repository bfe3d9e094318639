"""Connected components of an edge table by alternating large and small stars; nothing goes to the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest neighbour of u, u itself included; minima and join share one shuffle by u."""
    pairs = pairs.repartition("u")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least.hint("merge"), "u")


def _settled(pairs: DataFrame) -> bool:
    """Whether distinct pairs u > v are stars: each u has one v, and no v is a u.  A hub is counted in partial sums."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("top")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("top")))
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("top").alias("top"))
    return not ends.where("below > 1 or below = 1 and top = 1").agg(F.count(F.lit(1))).first()[0]


def below(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge that isn't the smallest one reachable, which is its component.

    Null ends and loops count for nothing; repeated edges are fine; without edges the result is empty."""
    rounds = Rounds(edges.sparkSession, "components")
    now = rounds.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct())
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = rounds.written(small.where(F.col("u") != F.col("v")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge, the smallest ones included; else as :func:`below`."""
    found = below(edges, a, b)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
