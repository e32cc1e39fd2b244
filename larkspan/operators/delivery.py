"""Delivery of messages: sends joined with their senders' logs, shares by way and class, delays, last words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.stats import ranked_quantiles
from larkspan.functions.text import masked, share

POINTS = {"least": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "most": 1.0}


def logged(lines: DataFrame) -> DataFrame:
    """src, mid, delivered, last: of a message's log lines (src, mid, t, line, n) the first instant that says delivered, and the last line's text; n orders lines."""
    done = F.when(F.col("line").contains("delivered mid="), F.struct("n", "t"))
    return lines.groupBy("src", "mid").agg(F.min(done)["t"].alias("delivered"), F.max_by("line", "n").alias("last"))


def bucket(hops: Column, without: str) -> Column:
    return F.when(hops.isNull(), without).when(hops <= 6, hops.cast("string")).otherwise("7+")


def place(name: Column) -> Column:
    """Where a bucket stands in a report: numbers, then 7+, then those without a way."""
    return F.when(name.isin("no path", "none"), 8).when(name == "7+", 7).otherwise(name.try_cast("int"))


def delivered(sends: DataFrame, logs: DataFrame, radio: DataFrame) -> DataFrame:
    """One row per send (marker, src, dst, cls, hops, mid, t_sent), in microseconds: ok, latency, route and radio buckets, and the last word of one that failed.

    logs: as logged() gives them; radio: src, dst, d, the fewest hops over
    forwarding stations. Sends without a mid have no log.
    """
    j = sends.join(logs, ["src", "mid"], "left").join(radio.select("src", "dst", "d"), ["src", "dst"], "left")
    ok = F.col("delivered").isNotNull()
    word = F.when(~ok, masked(F.coalesce("last", F.when(F.col("mid").isNull(), "no mid").otherwise("no log line"))))
    return j.select("marker", "src", "dst", "cls", "mid", ok.alias("ok"), (F.col("delivered") - F.col("t_sent")).alias("latency"), bucket(F.col("hops"), "no path").alias("route"), bucket(F.col("d"), "none").alias("radio"), word.alias("word"))


def shares(rows: DataFrame) -> DataFrame:
    """split, name, place, ok, sent, text: of all messages, and by route, radio hops and class."""
    f = rows.select(F.col("ok").cast("long").alias("ok"), F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ("all", "route", "radio", "class")]), F.array(F.lit("all"), "route", "radio", "cls"))).alias("split", "name"))
    sums = f.groupBy("split", "name").agg(F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("sent"))
    return sums.select("split", "name", F.coalesce(place(F.col("name")), F.lit(0)).cast("long").alias("place"), "ok", "sent", share(F.col("ok"), F.col("sent")).alias("text"))


def delays(rows: DataFrame, key: str) -> DataFrame:
    """Per class or bucket of delivered messages: how many, their mean and nearest-rank quantiles of the delay."""
    f = rows.filter("ok").select(key, "latency")
    return f.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency") / F.count(F.lit(1)), 6).alias("mean")).join(ranked_quantiles(f, [key], "latency", POINTS), key)


def last_words(rows: DataFrame, top: int = 25) -> DataFrame:
    return rows.filter("NOT ok").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)
