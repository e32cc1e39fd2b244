"""Operators on node feeds: buckets, newest per key, last rows, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400


def bucketed(feed: DataFrame, kinds: list[str], box: tuple[float, float, float, float], now: int, days: int, ahead: int) -> DataFrame:
    """feed (kind, lat, lon, stamp) with bucket: the first reason to drop a row, or kept. box: west, south, east, north, inclusive."""
    west, south, east, north = box
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return feed.withColumn(
        "bucket",
        F.when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "wrong kind")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "no position")
        .when(~inside, "outside")
        .when(F.col("stamp") - now > ahead * DAY, "future")
        .when(now - F.col("stamp") > days * DAY, "stale")
        .when(F.col("stamp").isNull(), "no stamp")
        .otherwise("kept"),
    )


def list_bucketed(nodes: DataFrame, box: tuple[float, float, float, float] | None, now: int, days: int | None = 90, ahead: int | None = 7, companions: bool = False) -> DataFrame:
    """A node list (kind, lat, lon, quality, stamp) with bucket: the first reason to drop a row, or kept. Without days, rows without a stamp are kept too."""
    inside = F.lit(True) if box is None else F.col("lat").between(box[1], box[3]) & F.col("lon").between(box[0], box[2])
    bucket = F.when(F.lit(not companions) & (F.col("kind") == "companion"), "wrong kind").when(F.col("lat").isNull() | F.col("lon").isNull(), "no position").when(F.col("quality") == "truncated", "truncated").when(~inside, "outside")
    if ahead is not None:
        bucket = bucket.when(F.col("stamp") - now > ahead * DAY, "future")
    if days is not None:
        bucket = bucket.when(now - F.col("stamp") > days * DAY, "stale").when(F.col("stamp").isNull(), "no stamp")
    return nodes.withColumn("bucket", bucket.otherwise("kept"))


def newest(rows: DataFrame, key: str, stamp: str, order: str) -> DataFrame:
    """Per key the row with the largest stamp (null least, the earlier of equal ones), with place: the order of the key's first row. Blank keys stand for themselves."""
    own = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.concat(F.lit("row"), F.col(order).cast("string"))).otherwise(F.col(key))
    w = W.partitionBy("_g")
    ranked = rows.withColumn("_g", own).withColumn("place", F.min(order).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc_nulls_last(stamp), order)))
    return ranked.filter("_k = 1").drop("_k", "_g")


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows with a blank key all stay."""
    k = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_k", k).filter((F.col("_k") == 1) | (F.col(key) == "")).drop("_k")


def merged(first: DataFrame, second: DataFrame, metres: int) -> DataFrame:
    """first, and the rows of second that no row of first is within metres of (id, name, x, y). They meet in a grid of that width."""
    at = lambda c: F.floor(F.col(c) / metres)
    near = first.select(F.col("x").alias("fx"), F.col("y").alias("fy"), F.explode(F.sequence(at("x") - 1, at("x") + 1)).alias("gx"), at("y").alias("g"))
    near = near.withColumn("gy", F.explode(F.sequence(F.col("g") - 1, F.col("g") + 1))).drop("g")
    held = second.withColumn("gx", at("x")).withColumn("gy", at("y"))
    close = (F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy")) <= metres * metres
    kept = held.alias("h").join(near.alias("n"), (F.col("h.gx") == F.col("n.gx")) & (F.col("h.gy") == F.col("n.gy")) & close, "left_anti")
    return first.select("id", "name", "x", "y").unionByName(kept.select("id", "name", "x", "y"))


def sensed(received: DataFrame) -> DataFrame:
    """Sensing records (rssi, src, lat, lon, hops_travelled, hops_remaining) with gate: the first reason why a record measures no link, or usable.

    A record needs a finite level, a sender, the sender's position, and one hop: a
    route still ahead means it was relayed, an unknown number of hops is refused.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf"))
    one = F.when(F.col("hops_remaining").isNotNull(), False).otherwise(F.col("hops_travelled") == 0)
    gate = F.when(~finite("rssi"), "bad_rssi").when(F.coalesce("src", F.lit("")) == "", "no_sender").when(~finite("lat") | ~finite("lon"), "no_tx_position").when(one.isNull(), "hops_unknown").when(~one, "relayed")
    return received.withColumn("gate", gate.otherwise("usable"))


def since_start(lines: DataFrame, keys: list[str], order: str, at: str, start: Column, until: float | None = None) -> DataFrame:
    """lines with at counted from start; a day is added to what lies before it. With until, a key's lines end before the first one later than that."""
    passed = F.col(at) - start
    out = lines.withColumn(at, F.when(passed < 0, passed + DAY).otherwise(passed))
    if until is None:
        return out
    late = F.max((F.col(at) > until).cast("int")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("_late", late).filter("coalesce(_late, 0) = 0").drop("_late")


def height_census(buildings: DataFrame, source: str, height: str) -> DataFrame:
    """Buildings, and those with a height, by where the height comes from."""
    return buildings.groupBy(source).agg(F.count(F.lit(1)).alias("buildings"), F.count(height).alias("with_height"), F.sum(height).alias("height_sum"))
