"""Quantiles as the reports define them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(value: Column, q: float) -> Column:
    """An aggregate: the value at rank floor(q * (n - 1) + 0.5) of the sorted values; null of none.

    It gathers a group's values; for groups without a bound use ranked_quantiles.
    """
    return nearest_rank_of(F.sort_array(F.collect_list(value)), q)


def nearest_rank_of(ordered: Column, q: float) -> Column:
    at = F.floor(q * (F.size(ordered) - 1) + 0.5).cast("int")
    return F.get(ordered, F.least(F.size(ordered) - 1, F.greatest(at, F.lit(0))))


def five_numbers(value: Column) -> list[Column]:
    return [nearest_rank(value, q).alias(n) for n, q in (("low", 0.0), ("q1", 0.25), ("middle", 0.5), ("q3", 0.75), ("high", 1.0))]


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A row per group with its nearest-rank quantiles. Counts equal values first, so a group's rows are never gathered: windows see distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("_hi", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    at = lambda q: F.floor(F.lit(q) * (F.col("_all") - 1) + 0.5)
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("_hi") > at(q), F.col(value))).alias(n) for n, q in points.items()])
