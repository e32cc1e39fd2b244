"""Receptions against all that shares their air, by running sums along time instead of pairs of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JUDGED = "eid long, rx long, talked boolean, swamped boolean"
#: Cells of the padded matrices in which sums run.
CELLS = 1 << 20
#: Rows of whole groups that are worked on at a time; a group (a channel's slice of time) is never cut.
ROWS = 20_000


def _running(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Ranges [first, last) in padded matrices of about CELLS: which ranges (sorted by length), places, and whether a place is one."""
    n = last - first
    lo = 0
    while lo < len(n):
        hi = int(np.searchsorted(n[lo:] * np.arange(1, len(n) - lo + 1), CELLS, "right")) + lo
        part = slice(lo, max(lo + 1, hi))
        steps = np.arange(max(1, int(n[part][-1])))
        at = first[part, None] + steps
        yield part, at, steps < n[part, None]
        lo = part.stop


def loudest(frames: dict[str, np.ndarray], begin: np.ndarray, end: np.ndarray, by_then: np.ndarray, eid: np.ndarray, rx: np.ndarray, level: Callable) -> np.ndarray:
    """For each stretch (begin, end) of a receiver, the most power (mW) that the frames but its own have together at any time of it.

    frames: eid, sid, power, s, e, of which none is empty. A stretch's sum starts
    with what is on at its begin and started at by_then or before (the begin, as a
    rule) and runs over the ends and starts within it, ends first; it is never above
    the most it gets to, so its error stays small against that.
    """
    out = np.zeros(len(begin))
    by = np.argsort(frames["s"], kind="stable")
    f = {k: v[by] for k, v in frames.items()}
    if not len(by) or not len(begin):
        return out
    longest = int((f["e"] - f["s"]).max())
    place = np.concatenate([f["s"], f["e"]])
    sign = np.repeat([1.0, -1.0], len(by))
    order = np.lexsort((sign, place))
    place, sign, who = place[order], sign[order], np.tile(np.arange(len(by)), 2)[order]
    mw = lambda at, rows: np.where(f["eid"][at] == eid[rows, None], 0.0, np.power(10.0, level(f["power"][at], f["sid"][at], rx[rows, None]) / 10.0))
    first, last = np.searchsorted(f["s"], begin - longest, "right"), np.searchsorted(f["s"], by_then, "right")
    last = np.maximum(first, last)
    rows = np.argsort(last - first, kind="stable")
    for part, at, real in _running(first[rows], last[rows]):
        own = rows[part]
        at = np.minimum(at, len(by) - 1)
        out[own] = (mw(at, own) * (real & (f["e"][at] > begin[own, None]))).sum(1)
    first = np.searchsorted(place, begin, "right")
    last = np.maximum(first, np.searchsorted(place, end, "left"))
    rows = np.argsort(last - first, kind="stable")
    rows = rows[(last > first)[rows]]
    for part, at, real in _running(first[rows], last[rows]):
        own = rows[part]
        at = np.minimum(at, len(place) - 1)
        change = mw(who[at], own) * sign[at] * real
        change[:, 0] += out[own]
        out[own] = np.maximum(out[own], np.cumsum(change, 1).max(1))
    return out


def _talked(g: np.ndarray, f: dict[str, np.ndarray], cg: np.ndarray, rx: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """Whether a frame of station rx overlaps (t0, t1) in the same group: of those that start before t1, the last end is after t0."""
    if not len(g):
        return np.zeros(len(cg), bool)
    by = np.lexsort((f["s"], f["sid"], g))
    g, sid, s, e = g[by], f["sid"][by], f["s"][by], f["e"][by]
    stations, pos = np.unique(np.concatenate([sid, rx]), return_inverse=True)
    key, asked = g * len(stations) + pos[: len(sid)], cg * len(stations) + pos[len(sid) :]
    # ends that run on within a key: each key's ends are lifted above those of the keys before
    base = min(int(e.min()), int(s.min()))
    lift = int(e.max()) - base + 1
    number = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    reach = np.maximum.accumulate(e - base + number * lift) - number * lift + base
    wide = max(int(s.max()), int(t1.max())) - min(int(s.min()), int(t1.min())) + 1
    low = min(int(s.min()), int(t1.min()))
    keys = np.unique(key)
    k = np.searchsorted(keys, asked)
    there = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == asked)
    at = np.searchsorted(number * wide + s - low, k * wide + t1 - low, "left") - 1
    at_ = np.maximum(at, 0)
    return there & (at >= 0) & (number[at_] == k) & (reach[at_] > t0)


def _judge(cols: dict[str, np.ndarray], heard: tuple[np.ndarray, np.ndarray], width: int, level: Callable, beaten: Callable) -> list[np.ndarray]:
    """cols: g, k, eid, sid, t0, t1, sf, power, own of frames by group; heard: rows of own frames and the receivers. Columns of JUDGED."""
    g, r = cols["g"], cols["k"] * width
    rel = {"t0": cols["t0"] - r, "t1": cols["t1"] - r}
    at, rx = heard
    known = {"eid": cols["eid"], "sid": cols["sid"], "power": cols["power"], "s": rel["t0"], "e": rel["t1"]}
    talked = _talked(g, known, g[at], rx, rel["t0"][at], rel["t1"][at])
    # groups side by side on one axis of time
    low = min(0, int(rel["t0"].min()), int(rel["t1"].min()))
    side = max(width, int(rel["t0"].max()), int(rel["t1"].max())) - low + 1
    along = lambda t, of: of * (2 * side) + t - low
    real = cols["t1"] > cols["t0"]
    begin, end = along(np.maximum(rel["t0"], 0), g), along(np.minimum(rel["t1"], width), g)
    # a frame that ends before it starts has the air between as one piece, with what is on all along
    by_then = np.where(real, begin, along(rel["t1"] - 1, g))
    swamped = np.zeros(len(at), bool)
    mine = level(cols["power"][at], cols["sid"][at], rx)
    classes = np.unique(cols["sf"][real])
    for same in (True, False):  # what a reception's own class does to it comes first: most are lost to that
        for osf in classes.tolist():
            todo = np.flatnonzero(~talked & ~swamped & (cols["t0"] != cols["t1"])[at] & ((cols["sf"][at] == osf) == same))
            of = real & (cols["sf"] == osf)
            frames = {"eid": cols["eid"][of], "sid": cols["sid"][of], "power": cols["power"][of], "s": along(rel["t0"], g)[of], "e": along(rel["t1"], g)[of]}
            most = loudest(frames, begin[at[todo]], end[at[todo]], by_then[at[todo]], cols["eid"][at[todo]], rx[todo], level)
            some = most > 0
            todo, most = todo[some], most[some]
            swamped[todo] = beaten(mine[todo], 10.0 * np.log10(most), cols["sf"][at[todo]], osf)
    return [cols["eid"][at], rx, talked, swamped]


def _groups(width: int, level: Callable, beaten: Callable):
    """Rows (cf, cb, k, eid, sid, t0, t1, sf, power, rxs) sorted by group to rows of JUDGED."""
    names = [c.split()[0] for c in JUDGED.split(", ")]

    def done(batch: pa.Table) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        keys = [batch[c].to_numpy() for c in ("cf", "cb", "k")]
        cols = {c: batch[c].to_numpy() for c in ("k", "eid", "sid", "t0", "t1", "sf", "power")}
        cols["g"] = np.cumsum(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], 0)]) - 1
        lists = batch["rxs"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        heard = np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), lists.flatten().to_numpy()
        if not len(heard[0]):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())], names)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _judge(cols, heard, width, level, beaten)], names)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n < ROWS:
                continue
            whole = pa.Table.from_batches(held)
            keys = [b[c].to_numpy() for c in ("cf", "cb", "k")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], 0))
            if len(cuts):
                last = n - len(b) + int(cuts[-1]) + 1
                yield done(whole.slice(0, last))
                held, n = whole.slice(last).to_batches(), n - last
        if n:
            yield done(pa.Table.from_batches(held))

    return judged


def judged(frames: DataFrame, receptions: DataFrame, longest: int, level: Callable, beaten: Callable, in_band: Callable) -> DataFrame:
    """eid, rx, talked, swamped of the receptions (eid, rx) of frames (eid, sid, t0, t1, freq, bw, sf, power; eid is their key) that share their air with others.

    talked: the receiver's own frame overlaps. swamped: at some time all frames of
    one spreading factor together are too strong: beaten(level, dBm, sf, osf).
    level(power, sid, rx) in dBm; both work on arrays. Rows that aren't listed
    share their air with nothing.

    Frames meet once per channel (centre and width) in whose band they are and
    slice of time, as long as the longest; what they are to each other there is
    summed along time, and pairs are never rows.
    """
    settings = frames.select("freq", "bw").distinct()
    a, b = settings.select(F.col("freq").alias("cf"), F.col("bw").alias("cb")), settings
    # as many rows as there are pairs of carriers in use
    channels = a.crossJoin(b).filter(F.col("cf").isNotNull() & F.col("freq").isNotNull() & in_band(F.col("cf"), F.col("cb"), F.col("freq"), F.col("bw")))
    heard = receptions.filter("rx IS NOT NULL").groupBy("eid").agg(F.collect_set("rx").alias("rxs"))
    first = lambda c: F.floor(c / longest)
    slices = F.sequence(first(F.col("t0")), first(F.greatest(F.col("t1") - 1, F.col("t0"))))
    rows = frames.filter("eid IS NOT NULL AND sid IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL").join(heard, "eid", "left")
    rows = rows.join(F.broadcast(channels), ["freq", "bw"])
    rxs = F.when((F.col("cf") == F.col("freq")) & (F.col("cb") == F.col("bw")), F.filter("rxs", lambda x: x != F.col("sid")))
    rows = rows.select("cf", "cb", F.explode(slices).alias("k"), "eid", "sid", "t0", "t1", F.col("sf").cast("long").alias("sf"), F.col("power").cast("long").alias("power"), rxs.alias("rxs"))
    met = rows.repartition("cf", "cb", "k").sortWithinPartitions("cf", "cb", "k").mapInArrow(_groups(longest, level, beaten), JUDGED)
    return met.filter("talked OR swamped").groupBy("eid", "rx").agg(F.max("talked").alias("talked"), F.max("swamped").alias("swamped"))
