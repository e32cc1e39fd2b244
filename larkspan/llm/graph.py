"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm._common import discard, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u, v), v < u: every neighbour above a node goes to the least of the neighbourhood, then every one below it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    above = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = above.groupBy("u").agg(F.min("v").alias("m"))
    below = above.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(low.withColumnRenamed("m", "v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 OR (c = 1 AND r = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node of its component, for every node of the edges (a, b).

    Rounds grow with the logarithm of the nodes, in whatever order the ids stand
    along a chain, and go on until every component is a star. Each round is a
    written table; nothing but a row reaches the driver.
    """
    held = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for k in itertools.count(1):
        if _settled(held):
            break
        new = stored(_stars(held), f"stars{k}")
        discard(held)
        held = new
    return held.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
