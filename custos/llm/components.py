"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node on an edge; ``root`` is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one, then
    every node's smaller neighbours to the smallest; the edges end as stars.
    Rounds grow with the logarithm of the number of nodes; they end when no
    node has two parents or is both a parent and a child. Minima are combined
    before they are shuffled and written before they are joined, so a node
    with very many neighbours is split at the join. Rounds are written to the
    shared folder; one row reaches the driver. Null nodes and loops are left
    out.
    """
    pair = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(
        f"{a} is not null and {b} is not null and hi != lo")
    stars = stored(pair.distinct(), "stars")
    while not _are_stars(stars):
        both = stars.union(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = stored(both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m")), "stars-least")
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = stored(large.distinct(), "stars-large")
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "stars-least")
        small = large.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = stored(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "stars")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        stars.select("lo", F.col("lo").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``hi`` has one ``lo`` and is nobody's ``lo``."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("lo", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
