"""Connected components of a link table by alternating star contractions, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """Per id that occurs in ``links`` (a, b): node, component (the smallest id reachable).

    Each round first points every larger neighbour of a node at the node's
    smallest neighbour, then does the same for the smaller ones; rows per round
    never exceed the links. Logarithmically many rounds are usual. Every round is
    written to the shared folder, so a lost executor repeats one round at most.
    Nothing is collected but each round's count of changes. Empty links give an
    empty result; loops and repeated or reversed links do no harm.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    for _ in range(ROUNDS):
        large = star(edges, True)
        small = written(star(large, False), "links")
        same = edges.join(small, ["u", "v"], "left_anti").isEmpty() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.selectExpr("u node", "v component").union(edges.selectExpr("v node", "v component").distinct())


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v). Minima are pre-aggregated before they are shuffled."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    if large:
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).selectExpr("e.v u", "e.m v")
    return moved.where("u <> v").distinct()
