"""Pair joins of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspan.plans.storage import cut


#: Rows that a block of every() has of each side.
BLOCK_ROWS = 256


def every(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of left with each row of right, for matrices that are the answer themselves: both are dealt over blocks by their rows' hash, as many as they ask for, and each block of left meets each of right, so no task holds the matrix or a side of it.

    The copies are sorted and merged: Spark takes them to be as small as the
    tables they were made from, and would broadcast them.
    """
    of = [max(1, -(-side.count() // BLOCK_ROWS)) for side in (left, right)]
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda side, n: F.pmod(F.xxhash64(*side.columns), F.lit(n))
    one = left.withColumn("_block", own(left, of[0])).withColumn("_other", numbers(of[1]))
    two = right.withColumn("_other", own(right, of[1])).withColumn("_block", numbers(of[0]))
    return one.join(two.hint("merge"), ["_block", "_other"]).drop("_block", "_other")


def near_points(points: DataFrame, x: str, y: str, radius: int) -> DataFrame:
    """ax, ay, bx, by, d2: distinct points at most radius apart, both ways and each with itself. They meet in a grid of that width: one side in its own cell, the other in nine."""
    at = lambda c: F.floor(F.col(c) / radius)
    places = cut(points.select(F.col(x).alias("x"), F.col(y).alias("y")).distinct())
    one = places.select(F.col("x").alias("ax"), F.col("y").alias("ay"), at("x").alias("gx"), at("y").alias("gy"))
    near = places.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(at("x") - 1, at("x") + 1)).alias("gx"), at("y").alias("_gy"))
    near = near.withColumn("gy", F.explode(F.sequence(F.col("_gy") - 1, F.col("_gy") + 1)))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return one.join(near.hint("merge"), ["gx", "gy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select("ax", "ay", "bx", "by", "d2")


def within(points: DataFrame, ident: str, x: str, y: str, radius: int) -> DataFrame:
    """a, b, d2: pairs at most radius apart, a < b. Places meet once, however many points lie there; their points are gathered in parts of AT_ONCE."""
    rows = points.select(F.col(ident).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")).filter("i IS NOT NULL")
    part = F.pmod(F.xxhash64("i"), F.ceil(F.count(F.lit(1)).over(W.partitionBy("x", "y")) / AT_ONCE))
    held = cut(rows.withColumn("part", part).groupBy("x", "y", "part").agg(F.collect_list("i").alias("ids")))
    side = lambda p: held.select(F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("ids").alias(f"{p}s"))
    met = near_points(points, x, y, radius).join(side("a").hint("merge"), ["ax", "ay"]).join(side("b").hint("merge"), ["bx", "by"])
    return met.select("d2", "bs", F.explode("as").alias("a")).select("a", F.explode("bs").alias("b"), "d2").filter("a < b").select("a", "b", "d2")


#: Points of one place that are held in a row.
AT_ONCE = 1000


def nearest(points: DataFrame, keys: list[str], x: str, y: str, sites: DataFrame, width: int, reach: int) -> DataFrame:
    """keys, id, d2: for each point (x, y) the nearest of sites (id, x, y); ties to the smaller id. d2 is rounded to four digits.

    Points and sites meet in a grid of width: one side in its own cell, the other
    in nine, which settles every point that has a site within the width. The rest
    meets again in a grid four times as wide, up to reach, the extent of it all.
    """
    left, done = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), None
    while True:
        at = lambda c, w=width: F.floor(c / w)
        near = sites.select("id", F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.explode(F.sequence(at(F.col("x")) - 1, at(F.col("x")) + 1)).alias("_gx"), at(F.col("y")).alias("_g"))
        near = near.withColumn("_gy", F.explode(F.sequence(F.col("_g") - 1, F.col("_g") + 1))).drop("_g")
        d2 = F.round(F.pow(F.col("_sx") - F.col("_x"), F.lit(2.0)) + F.pow(F.col("_sy") - F.col("_y"), F.lit(2.0)), 4)
        met = left.withColumn("_gx", at(F.col("_x"))).withColumn("_gy", at(F.col("_y"))).join(near, ["_gx", "_gy"])
        best = met.groupBy(*keys).agg(F.min(F.struct(d2.alias("d2"), F.col("id"))).alias("_b")).select(*keys, "_b.id", "_b.d2")
        if width <= reach:
            best = best.filter(F.col("d2") <= float(width) * width)
        best = cut(best)
        done = best if done is None else done.unionByName(best)
        if width > reach:
            return done
        left = cut(left.join(best.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            return done
        width *= 4
