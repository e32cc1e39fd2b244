"""Radio arithmetic as Column expressions: levels, thresholds, losses, time on air, antennas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
THERMAL_DBM_HZ, NOISE_FIGURE_DB, DEFAULT_BW = -174.0, 6.0, 125_000
SENSITIVITY_DB = {5: -2.5, 6: -5.0, 7: -7.5, 8: -10.0, 9: -12.5, 10: -15.0, 11: -17.5, 12: -20.0}
SLOWEST_DB = -20.0
SAME_SF_DB, CAPTURE_DB = 6.0, 6.0
#: Lead a frame at the row's spreading factor (7-12) needs over interference at the column's (7-12).
INTER_SF_DB = [
    [6, -8, -9, -9, -9, -9],
    [-11, 6, -11, -12, -13, -13],
    [-15, -13, 6, -13, -14, -15],
    [-19, -18, -17, 6, -17, -18],
    [-22, -22, -21, -20, 6, -20],
    [-25, -25, -25, -24, -23, 6],
]
SENSE_DBM_AT_1KHZ, SENSE_ABOVE_DB = -117.0, 15.0
CARRIER_SHARE = 0.25
LIGHT, EARTH_M, K_FACTOR = 299_792_458.0, 6_371_008.8, 4.0 / 3.0
BANDS = [("433", 433_920_000, 410_000_000, 525_000_000), ("868", 868_000_000, 850_000_000, 880_000_000), ("915", 915_000_000, 902_000_000, 930_000_000)]
RX_SENSITIVITY_125 = {7: -124.0, 8: -126.5, 9: -129.0, 10: -132.0, 11: -134.5, 12: -137.0}
POWER_LADDER = [2, 5, 8, 11, 14, 17, 20, 22, 27]


def bandwidth(bw: Column) -> Column:
    """The stated bandwidth; null and zero mean the default."""
    return F.coalesce(F.nullif(bw.cast("double"), F.lit(0.0)), F.lit(float(DEFAULT_BW)))


def milliwatts(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), dbm / 10.0)


def dbm(mw: Column) -> Column:
    """10 log10, minus infinity for no power."""
    return F.when(mw > 0, 10.0 * F.log10(mw)).otherwise(F.lit(float("-inf")))


def noise_floor(bw: Column, figure: float = NOISE_FIGURE_DB) -> Column:
    return F.lit(THERMAL_DBM_HZ + figure) + 10.0 * F.log10(F.greatest(bandwidth(bw), F.lit(1.0)))


def sensitivity(sf: Column) -> Column:
    out = F.lit(SLOWEST_DB)
    for k, v in SENSITIVITY_DB.items():
        out = F.when(sf == k, F.lit(v)).otherwise(out)
    return out


def rejection(sf: Column, other: Column) -> Column:
    """Lead in dB that sf needs over other; unknown counts as the same."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in INTER_SF_DB])
    at = lambda c: F.least(F.lit(12), F.greatest(F.lit(7), c.cast("int"))) - 7
    return F.when(sf.isNull() | other.isNull() | (sf == other), F.lit(SAME_SF_DB)).otherwise(F.get(F.get(rows, at(sf)), at(other)))


def rejections(sf: np.ndarray, other: int) -> np.ndarray:
    """The same over an array of known factors."""
    at = np.clip(sf, 7, 12) - 7
    return np.where(sf == other, SAME_SF_DB, np.array(INTER_SF_DB, np.float64)[at, min(12, max(7, other)) - 7])


def sense_threshold(bw: Column) -> Column:
    return 10.0 * F.log10(F.greatest(bandwidth(bw), F.lit(1000.0)) / 1000.0) + (SENSE_DBM_AT_1KHZ + SENSE_ABOVE_DB)


def audible(level: Column, bw: Column, sf: Column) -> Column:
    return F.coalesce(level >= noise_floor(bw) + sensitivity(sf), F.lit(False))


def same_carrier(a: Column, b: Column, bw: Column) -> Column:
    """Within a quarter of the bandwidth; null is the same carrier as null only."""
    return F.coalesce(F.abs(a - b) <= CARRIER_SHARE * bandwidth(bw), a.eqNullSafe(b))


def in_band(fa: Column, bwa: Column, fb: Column, bwb: Column) -> Column:
    return F.coalesce(F.abs(fa - fb) < (bandwidth(bwa) + bandwidth(bwb)) / 2.0, fa.eqNullSafe(fb))


def first_metre_loss(freq: Column) -> Column:
    return 20.0 * F.log10(F.lit(4.0 * math.pi) * F.greatest(freq.cast("double"), F.lit(1.0)) / LIGHT)


def log_distance_loss(freq: Column, exponent: float, metres: Column) -> Column:
    return first_metre_loss(freq) + 10.0 * exponent * F.log10(F.greatest(metres, F.lit(1.0)))


def free_space_loss(freq: Column, metres: Column) -> Column:
    return log_distance_loss(freq, 2.0, metres)


def band_of(freq: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, low, high in reversed(BANDS):
        out = F.when(freq.between(low, high), F.lit(name)).otherwise(out)
    return out


def band_correction(freq: Column) -> Column:
    """20 log10 of the carrier over its band's centre; null outside all bands."""
    centre = F.lit(None).cast("double")
    for _, f0, low, high in reversed(BANDS):
        centre = F.when(freq.between(low, high), F.lit(float(f0))).otherwise(centre)
    return 20.0 * F.log10(freq / centre)


def time_on_air(sf: Column, bw: Column, coding: Column, preamble: Column, payload: Column, implicit: Column, crc: Column) -> Column:
    """Seconds on the air; 0 for settings that don't exist."""
    symbol = F.pow(F.lit(2.0), sf) / bw
    slow = F.when(symbol > 0.016, 1).otherwise(0)
    bits = 8.0 * payload - 4.0 * sf + 28.0 + F.when(crc, 16.0).otherwise(0.0) - F.when(implicit, 20.0).otherwise(0.0)
    symbols = 8.0 + F.greatest(F.ceil(bits / (4.0 * (sf - 2 * slow))) * coding, F.lit(0)).cast("double")
    known = (sf > 0) & (bw > 0) & coding.between(5, 8)
    return F.when(known, (preamble + 4.25) * symbol + symbols * symbol).otherwise(F.lit(0.0))


def wrap180(deg: Column) -> Column:
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def azimuth(dx: Column, dy: Column) -> Column:
    """Clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def elevation(dx: Column, dy: Column, rise: Column) -> Column:
    """Above the horizon, over an earth of four thirds its radius."""
    d = F.hypot(dx, dy)
    return F.degrees(F.atan2(rise - d * d / (2.0 * K_FACTOR * EARTH_M), F.greatest(d, F.lit(1e-6))))


def antenna_gain(peak: Column, vertical: Column, floor: Column, tilt: Column, el: Column, horizontal: Column | None = None, off_az: Column | None = None) -> Column:
    down = 12.0 * F.pow((el - tilt) / vertical, F.lit(2.0))
    if horizontal is not None:
        down = down + F.coalesce(12.0 * F.pow(off_az / F.nullif(horizontal, F.lit(0.0)), F.lit(2.0)), F.lit(0.0))
    return peak - F.least(down, floor)


def short_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere, for short distances."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    return EARTH_M * F.hypot((d - b) * F.cos((a + c) / 2), c - a)


def receiver_sensitivity(sf: Column, bw_khz: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in RX_SENSITIVITY_125.items():
        out = F.when(sf == k, F.lit(v)).otherwise(out)
    return out + 10.0 * F.log10(bw_khz / 125.0)


def ladder_step(ceiling: Column) -> Column:
    """The highest power of the ladder that the ceiling allows."""
    return F.array_max(F.filter(F.array(*[F.lit(p) for p in POWER_LADDER]), lambda p: p <= ceiling))


# dBm that the chip gives at least and at most, and that a front end gives at most.
CHIP_DBM, FRONT_END_DBM = (-9, 22), 27
#: What a receiver's setting must share with a frame's for the frame to be decoded.
MATCH = ("bw", "sf", "sync")
#: A frame's longest time in the air, in microseconds.
MAX_FRAME_US = 60_000_000
# Fixed values of pair tables: no path, and what is known of a pair.
NEVER, NEAR_FIELD, OFF_PACK, BEYOND_RADIUS, LOS_CLEAR = float("inf"), 1, 2, 4, 8


def modem_matches(state: Column, frame: Column) -> Column:
    """Whether a receiver (struct of freq, bw, sf, sync) is set to decode a frame; missing fields match missing ones."""
    out = same_carrier(state["freq"], frame["freq"], frame["bw"])
    for k in MATCH:
        out = out & state[k].eqNullSafe(frame[k])
    return out


def station_power(own: Column) -> Column:
    """struct(max_dbm, front_end, ok): a node's maximum power, the chip's if none is stated; whether that needs a front end; whether what is stated lies within the limits."""
    top = F.coalesce(own, F.lit(float(CHIP_DBM[1]))).cast("double")
    return F.struct(top.alias("max_dbm"), (top > CHIP_DBM[1]).alias("front_end"), F.coalesce(own.between(CHIP_DBM[0], FRONT_END_DBM), F.lit(True)).alias("ok"))


def frame_times(t0: Column, t_end: Column, t_pre: Column, t_hdr: Column, now: Column) -> Column:
    """struct(start, end, pre, hdr) of a frame as it goes on the air: not before now, its length, preamble and header in order and within the longest frame."""
    zero = F.lit(0).cast("long")
    start = F.greatest(t0, now)
    span = F.greatest(zero, F.least(F.coalesce(t_end, t0) - t0, F.lit(MAX_FRAME_US).cast("long")))
    pre = F.greatest(zero, F.least(F.coalesce(t_pre, t0) - t0, span))
    hdr = F.greatest(pre, F.least(F.coalesce(t_hdr, t0) - t0, span))
    return F.struct(start.alias("start"), (start + span).alias("end"), (start + pre).alias("pre"), (start + hdr).alias("hdr"))


def reply_cell(status: Column, text: Column, loss: Column, model: Column, verdict: Column, freq: Column, metres: Column, full: str = "p1812") -> Column:
    """struct(loss, flags) of a pair from a link answer: an error's status and text, or loss, model and clearance. Null for errors that say nothing about the pair."""
    cell = lambda db, flags: F.struct(db.cast("double").alias("loss"), F.lit(flags).cast("int").alias("flags") if isinstance(flags, int) else flags.cast("int").alias("flags"))
    known = F.when(F.coalesce(model, F.lit(full)) != full, NEAR_FIELD).otherwise(0) + F.when(F.coalesce(verdict == "clear", F.lit(False)), LOS_CLEAR).otherwise(0)
    return (
        F.when(status.isNull(), cell(loss, known))
        .when(text.contains("leaves the pack"), cell(F.lit(NEVER), OFF_PACK))
        .when(text.contains("window cap"), cell(F.lit(NEVER), BEYOND_RADIUS))
        .when(text.contains("within 20 m") | text.contains("too short"), cell(free_space_loss(freq, metres), NEAR_FIELD))
    )
