"""What a receiver follows: the lock of a demodulator on one frame at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspan.functions import radio
from larkspan.functions.radio import SAME_SF_DB

FOLLOWED = "eid long, rx long, t0 long, t1 long, level double, lost boolean"


class Lock:
    """A receiver's lock, told of frames in the order they begin."""

    def __init__(self, lead: float = SAME_SF_DB) -> None:
        self.lead, self.held = lead, None

    def begin(self, frame: tuple) -> list[tuple]:
        """frame: eid, rx, t0, t1, level. Returns the rows that are settled now, with whether they were lost."""
        held = self.held
        if held is not None and held[3] <= frame[2]:
            self.held = None
            done = [(*held, False)]
        elif held is not None and frame[4] - held[4] < self.lead:
            return [(*frame, True)]
        else:
            done = [(*held, True)] if held is not None else []
        self.held = frame
        return done

    def end(self) -> list[tuple]:
        held, self.held = self.held, None
        return [(*held, False)] if held is not None else []


def _fold(lead: float):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lock, rx, names = Lock(lead), None, ["eid", "rx", "t0", "t1", "level", "lost"]
        for f in frames:
            out: list[tuple] = []
            for row in f[["eid", "rx", "t0", "t1", "level"]].itertuples(index=False, name=None):
                if row[1] != rx:
                    out += lock.end()
                    rx = row[1]
                out += lock.begin(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(lock.end(), columns=names)

    return fold


def followed(receptions: DataFrame, lead: float = SAME_SF_DB) -> DataFrame:
    """receptions (eid, rx, t0, t1, level) with lost: a frame that begins while another is followed is lost unless it leads that one by lead dB, which then is.

    Rows are dealt by receiver, sorted, and folded as they stream past: a task
    holds one row per receiver, however many frames it hears.
    """
    rows = receptions.select("eid", "rx", "t0", "t1", "level").repartition("rx").sortWithinPartitions("rx", "t0", "eid")
    return rows.mapInPandas(_fold(lead), FOLLOWED)


# Fixed value: the lead in whole dB by which a later frame takes a receiver over under the pairwise rule.
PAIRWISE_DB = 6.0
HEARD = "eid long, rx long, slot int, t0 long, t1 long, level double, starts string, lost boolean"
#: What a slot's rows are, in the order they count at one instant.
STATE, SENT, FRAME = 0, 1, 2


class Slot:
    """A receiver's slot: what it last said it does, until when its station sends, and the frame it follows."""

    def __init__(self, lead: float) -> None:
        self.lead, self.mode, self.until, self.held = lead, None, None, None

    def state(self, mode: str | None) -> list:
        self.mode = mode
        return [] if mode == "RX" else self.free()

    def free(self) -> list:
        """The demodulator lets go; the frame's reception goes on to its end."""
        held, self.held = self.held, None
        return [held] if held is not None else []

    def sent(self, until: int) -> list:
        self.until = until
        return self.free()

    def frame(self, row: list, decodable: bool) -> list:
        """row: eid, rx, slot, t0, t1, level, starts, lost. Returns the rows that are settled now."""
        done = self.free() if self.held is not None and self.held[4] <= row[3] else []
        if self.mode not in ("RX", "CAD") or (self.until is not None and self.until > row[3]):
            return done
        if not decodable:
            return [*done, [*row[:6], None, None]]
        if self.mode == "CAD":
            return [*done, [*row[:6], "energy", None]]
        if self.held is not None and row[5] - self.held[5] < self.lead:
            return [*done, [*row[:6], "energy", True]]
        if self.held is not None:
            self.held[7] = True
            done += self.free()
        self.held = [*row[:6], "frame", False]
        return done


def _slots(lead: float):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, at, names = Slot(lead), None, [c.split()[0] for c in HEARD.split(", ")]
        for f in frames:
            out: list = []
            for rx, k, t, kind, n, t1, level, mode, decodable in f.itertuples(index=False, name=None):
                if (rx, k) != at:
                    out += slot.free()
                    slot, at = Slot(lead), (rx, k)
                if kind == STATE:
                    out += slot.state(mode)
                elif kind == SENT:
                    out += slot.sent(t1)
                else:
                    out += slot.frame([n, rx, k, t, t1, level], bool(decodable))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(slot.free(), columns=names)

    return fold


def heard(arrivals: DataFrame, states: DataFrame, sent: DataFrame, pairwise: bool = False) -> DataFrame:
    """What each listening slot makes of the frames that reach it: eid, rx, slot, t0, t1, level, starts, lost.

    arrivals: eid, rx, slot, t0, t1, freq, bw, sf, sync, level. states: rx, slot,
    t, n (order at one instant), mode, freq, bw, sf, sync. sent: rx, t0, t1 of a
    receiver's own frames, during which it hears nothing. starts is frame where a
    slot locks on, energy where it is only told that something is there (it is in
    CAD, or follows a frame that this one doesn't lead), null where the frame
    can't be decoded there; lost tells whether the reception that ends with the
    frame was lost to another, null if there is none. Leaving RX, or sending,
    frees a demodulator without losing what it followed. The pairwise rule
    compares whole dB.

    A slot's state at a frame is looked up by one window; the rows then stream
    past in the order of that window, and a task holds one row per slot.
    """
    setting = lambda p="": F.struct(*[F.col(f"{p}{c}") for c in ("mode", "freq", "bw", "sf", "sync")])
    none = F.lit(None)
    said = states.select("rx", "slot", "t", F.lit(STATE).alias("kind"), F.col("n").cast("long").alias("n"), none.cast("long").alias("t1"), none.cast("double").alias("level"), setting().alias("said"), none.cast("struct<freq:bigint,bw:bigint,sf:bigint,sync:bigint>").alias("on"))
    own = sent.join(states.select("rx", "slot").distinct(), "rx").select("rx", "slot", F.col("t0").alias("t"), F.lit(SENT).alias("kind"), F.lit(0).cast("long").alias("n"), "t1", none.cast("double").alias("level"), none.alias("said"), none.alias("on"))
    level = F.bround("level") if pairwise else F.col("level")
    came = arrivals.select("rx", "slot", F.col("t0").alias("t"), F.lit(FRAME).alias("kind"), F.col("eid").alias("n"), "t1", level.cast("double").alias("level"), none.alias("said"), F.struct(*[F.col(c).cast("long").alias(c) for c in ("freq", "bw", "sf", "sync")]).alias("on"))
    every = said.unionByName(own).unionByName(came)
    w = W.partitionBy("rx", "slot").orderBy("t", "kind", "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = every.withColumn("now", F.last("said", ignorenulls=True).over(w))
    decodable = radio.modem_matches(F.col("now"), F.col("on")) & radio.audible(F.col("level"), F.col("on.bw"), F.col("on.sf"))
    rows = rows.select("rx", "slot", "t", "kind", "n", "t1", "level", F.col("said.mode").alias("mode"), F.coalesce(decodable, F.lit(False)).alias("decodable"))
    return rows.repartition("rx", "slot").sortWithinPartitions("rx", "slot", "t", "kind", "n").mapInPandas(_slots(PAIRWISE_DB if pairwise else SAME_SF_DB), HEARD)
