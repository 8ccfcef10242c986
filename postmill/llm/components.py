"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import written


def _towards_smallest(edges: DataFrame, by: str, other: str) -> DataFrame:
    """Each row's two nodes and the smallest neighbour of node ``by``."""
    low = edges.groupBy(by).agg(F.min(other).alias("low"))
    return edges.join(written(low, "stars"), by).withColumn("low", F.least("low", by))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which itself has none: then stars are components."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node, component`` of every linked node; the component is its smallest node.

    Each round points all larger neighbours of a node to its smallest one, then
    does the same for smaller neighbours.  Rows never outgrow the links and a
    node with many links is split by the join.  Loops and repeats do no harm; no
    links give no rows.  With ``rounds`` it may stop early: nodes of equal
    component are connected then, but connected nodes may still differ.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    turn = 0
    while turn != rounds:
        turn += 1
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        large = _towards_smallest(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.where("u <> v").distinct(), "links")
        small = _towards_smallest(large, "u", "v")
        small = small.select("u", F.col("low").alias("v")).union(small.select(F.col("v"), F.col("low")).toDF("u", "v"))
        edges = written(small.where("u <> v").distinct(), "links")
        if not rounds and _are_stars(edges):
            break
    rows = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    rows = rows.union(rows.select("component", "component").distinct().toDF("node", "component"))
    return rows.groupBy("node").agg(F.min("component").alias("component")) if rounds else rows
