"""Projection and polygon expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84; fixed values.
AXIS_M, FLATTENING, SCALE, FALSE_EAST_M = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS_M = AXIS_M / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)


def _series(*rows: list[tuple[int, int]]) -> list[float]:
    """Krüger's coefficients from fractions of ascending powers of N; row j begins at N ** (j + 1)."""
    return [sum(a / b * N ** (j + 1 + i) for i, (a, b) in enumerate(row)) for j, row in enumerate(rows)]


#: Forward and inverse series to the sixth order.
ALPHA = _series(
    [(1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)],
    [(13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)],
    [(61, 240), (-103, 140), (15061, 26880), (167603, 181440)],
    [(49561, 161280), (-179, 168), (6601661, 7257600)],
    [(34729, 80640), (-3418889, 1995840)],
    [(212378941, 319334400)],
)
BETA = _series(
    [(1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)],
    [(1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)],
    [(17, 480), (-37, 840), (-209, 4480), (5569, 90720)],
    [(4397, 161280), (-11, 504), (-830251, 7257600)],
    [(4583, 161280), (-108847, 3991680)],
    [(20648693, 638668800)],
)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def utm(lat: Column, lon: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - (6.0 * zone - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east = eta + _sum([a * F.cos(2.0 * (j + 1) * xi) * F.sinh(2.0 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
    up = xi + _sum([a * F.sin(2.0 * (j + 1) * xi) * F.cosh(2.0 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
    return FALSE_EAST_M + SCALE * RADIUS_M * east, SCALE * RADIUS_M * up + (0.0 if north else 10_000_000.0)


def degrees_of_utm(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Latitude and longitude; the conformal latitude is turned back by Newton's steps, unrolled."""
    xi, eta = (y - (0.0 if north else 10_000_000.0)) / (SCALE * RADIUS_M), (x - FALSE_EAST_M) / (SCALE * RADIUS_M)
    a = xi - _sum([b * F.sin(2.0 * (j + 1) * xi) * F.cosh(2.0 * (j + 1) * eta) for j, b in enumerate(BETA)])
    b = eta - _sum([c * F.cos(2.0 * (j + 1) * xi) * F.sinh(2.0 * (j + 1) * eta) for j, c in enumerate(BETA)])
    lam = F.atan2(F.sinh(b), F.cos(a))
    start = F.sin(a) / F.sqrt(F.sinh(b) * F.sinh(b) + F.cos(a) * F.cos(a))  # tangent of the conformal latitude

    def better(t: Column, _: Column) -> Column:
        s = F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * t / F.sqrt(1.0 + t * t)))
        conformal = t * F.sqrt(1.0 + s * s) - s * F.sqrt(1.0 + t * t)
        step = (start - conformal) / F.sqrt(1.0 + conformal * conformal) * (1.0 + (1.0 - ECCENTRICITY**2) * t * t) / ((1.0 - ECCENTRICITY**2) * F.sqrt(1.0 + t * t))
        return t + step

    tangent = F.aggregate(F.array(*[F.lit(i) for i in range(5)]), start, better)
    return F.degrees(F.atan(tangent)), F.degrees(lam) + (6.0 * zone - 183.0)


def _edges(ring: Column) -> Column:
    """A ring's edges (array of struct x, y) as structs p, q; the last point joins the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _total(edges: Column, of) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + of(e["p"], e["q"]))


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def ring_area(ring: Column) -> Column:
    """0 for fewer than three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(_total(_edges(ring), _cross)) / 2.0)


def ring_centroid(ring: Column) -> Column:
    """struct(x, y); the first point of a ring without area."""
    e = _edges(ring)
    twice = _total(e, _cross)
    mean = lambda k: _total(e, lambda p, q: (p[k] + q[k]) * _cross(p, q)) / (3.0 * twice)
    flat = (F.size(ring) < 3) | (F.abs(twice) < 1e-9)
    pick = lambda k: F.when(flat, F.get(ring, F.lit(0))[k]).otherwise(mean(k)).alias(k)
    return F.struct(pick("x"), pick("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return ((p["y"] > y) != (q["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def clip_box(a: list[Column], b: list[Column]) -> Column:
    """struct(west, south, east, north) of two boxes' common part; null if they only touch or miss."""
    low, high = [F.greatest(a[i], b[i]) for i in (0, 1)], [F.least(a[i], b[i]) for i in (2, 3)]
    return F.when((low[0] < high[0]) & (low[1] < high[1]), F.struct(low[0].alias("west"), low[1].alias("south"), high[0].alias("east"), high[1].alias("north")))


def bilinear(q00: Column, q01: Column, q10: Column, q11: Column, fx: Column, fy: Column) -> Column:
    return (q00 * (1.0 - fx) + q01 * fx) * (1.0 - fy) + (q10 * (1.0 - fx) + q11 * fx) * fy


#: Metres per degree on synthetic ground: a nautical mile to the minute.
SYNTHETIC_M = 1852.0 * 60


def synthetic_xy(lat: Column, lon: Column) -> Column:
    return F.struct((lon * SYNTHETIC_M).alias("x"), (lat * SYNTHETIC_M).alias("y"))


def synthetic_latlon(x: Column, y: Column) -> Column:
    return F.struct((y / SYNTHETIC_M).alias("lat"), (x / SYNTHETIC_M).alias("lon"))


def boxes_meet(a: Column, b: Column, closed: bool) -> Column:
    """Whether boxes (structs of west, south, east, north) meet: closed ones also where they only touch, half-open ones not."""
    less = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    return less(a["west"], b["east"]) & less(b["west"], a["east"]) & less(a["south"], b["north"]) & less(b["south"], a["north"])
