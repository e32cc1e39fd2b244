"""Operators on cells (row, col, value): filters, maxima, blocks, sums, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _along(df: DataFrame, key: str, by: str, half: int, pick, value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(by).rangeBetween(-half, half)
    return df.withColumn(value, pick(value).over(w))


def opening(df: DataFrame, half: int, value: str = "v") -> DataFrame:
    """Morphological opening by a square of 2 * half + 1: a minimum filter, then a maximum filter, each in two passes."""
    for pick in (F.min, F.max):
        df = _along(_along(df, "row", "col", half, pick, value), "col", "row", half, pick, value)
    return df


def local_maxima(df: DataFrame, half: int, value: str = "v") -> DataFrame:
    """Cells that no cell of their square exceeds; of equal ones the first by (row, col)."""
    ranked = df.withColumn("_r", F.struct(F.col(value), (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))
    out = _along(_along(ranked.withColumn("_m", F.col("_r")), "row", "col", half, F.max, "_m"), "col", "row", half, F.max, "_m")
    return out.filter(F.col("_m") == F.col("_r")).select(*df.columns)


def blocks(df: DataFrame, size: int, value: str = "v") -> DataFrame:
    """brow, bcol, total, cells of square blocks; blocks without a positive total are dropped."""
    at = lambda c: F.floor(F.col(c) / size).alias(f"b{c}")
    return df.groupBy(at("row"), at("col")).agg(F.sum(value).alias("total"), F.count(value).alias("cells")).filter("total > 0")


def summed_area(df: DataFrame, value: str = "v") -> DataFrame:
    """df with area: the sum over all cells up to (row, col)."""
    part = df.withColumn("_row", F.sum(value).over(W.partitionBy("row").orderBy("col")))
    return part.withColumn("area", F.sum("_row").over(W.partitionBy("col").orderBy("row"))).drop("_row")


def split_cells(df: DataFrame, steps: int, to: int, value: str = "v") -> DataFrame:
    """Deals each cell's value over steps * steps samples and sums them by cells that are to samples wide; totals are kept."""
    sample = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = lambda c, k: F.floor((F.col(c) * steps + F.col(k)) / to).alias(c)
    return sample.groupBy(at("row", "i"), at("col", "j")).agg((F.sum(value) / float(steps * steps)).alias("value"))


def disc_cells(sites: DataFrame, radius: int) -> DataFrame:
    """site, row, col of the cells within radius of each site (site, row, col); each row of a disc is one column span."""
    dr = sites.withColumn("dr", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    half = F.floor(F.sqrt(F.lit(float(radius * radius)) - F.col("dr") * F.col("dr"))).cast("long")
    return dr.withColumn("half", half).select("site", (F.col("row") + F.col("dr")).alias("row"), F.explode(F.sequence(F.col("col") - F.col("half"), F.col("col") + F.col("half"))).alias("col"))


def gap_accounting(cells: DataFrame, served: DataFrame, k: int, weight: str = "v") -> DataFrame:
    """total, served, served_k, uncovered of the positive weights, given the cells that sites serve (row, col per site)."""
    counts = served.groupBy("row", "col").agg(F.least(F.count(F.lit(1)), F.lit(254)).alias("n"))
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0)
    n = F.coalesce(F.col("n"), F.lit(0))
    return cells.join(counts, ["row", "col"], "left").agg(F.sum(w).alias("total"), F.sum(F.when(n >= 1, w).otherwise(0)).alias("served"), F.sum(F.when(n >= k, w).otherwise(0)).alias("served_k"), F.sum(F.when(n == 0, w).otherwise(0)).alias("uncovered"))


def gap_clusters(cells: DataFrame, served: DataFrame, size: int, weight: str = "v") -> DataFrame:
    """Uncovered positive weight by blocks: brow, bcol, weight, cells, crow, ccol (weighted centre)."""
    left = cells.join(served.select("row", "col").distinct(), ["row", "col"], "left_anti").filter(F.col(weight) > 0)
    at = lambda c: F.floor(F.col(c) / size).alias(f"b{c}")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col(weight)) / F.sum(weight), 6).alias(f"c{c}")
    return left.groupBy(at("row"), at("col")).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("cells"), mean("row"), mean("col"))
