"""Streaming reports over frames (eid, sid, ts, span, freq): the same figures as the batch reports, as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def frames(events: DataFrame) -> DataFrame:
    """The bridge's frames of a stream of events."""
    return events.select(F.col("event_id").alias("eid"), F.col("user_id").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), (F.floor(F.col("value") * 1000000).cast("long") + 100000).alias("span"), F.col("event_type").alias("kind"))


def airtime(stream: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Airtime per station in windows one after the other."""
    w = F.window("ts", every)
    return stream.withWatermark("ts", late).groupBy(w, "sid").agg(F.count(F.lit(1)).alias("frames"), F.sum("span").alias("us")).select(F.col("window.start").alias("start"), "sid", "frames", "us")


def sliding_airtime(stream: DataFrame, width: str = "1 hour", step: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Airtime per station in windows that overlap, for duty-cycle watch."""
    w = F.window("ts", width, step)
    return stream.withWatermark("ts", late).groupBy(w, "sid").agg(F.sum("span").alias("us")).select(F.col("window.start").alias("start"), "sid", "us")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a station's frames that begin less than gap apart."""
    s = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(s, "sid").agg(F.count(F.lit(1)).alias("frames")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "sid", "frames")


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each frame once, however often it is sent again within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["eid"])


def _busiest(key: tuple, frames_: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, n = state.get if state.exists else (0, 0)
    for f in frames_:
        total, n = total + int(f["span"].sum()), n + len(f)
    state.update((total, n))
    yield pd.DataFrame({"sid": [key[0]], "us": [total], "frames": [n]})


def running_totals(stream: DataFrame) -> DataFrame:
    """Per station the airtime so far, kept as state; a row whenever it grows."""
    return stream.groupBy("sid").applyInPandasWithState(_busiest, "sid long, us long, frames long", "us long, frames long", "update", GroupStateTimeout.NoTimeout)
