"""Path expressions over a terrain profile: arrays of distance (m, from 0, ascending) and height (m above the sea)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT_M_US = 299.792458
#: Class heights in the order Open, Water, LowVegetation, Forest, Suburban, Urban, DenseUrban, Industrial.
CLASS_HEIGHT_M = [0.0, 0.0, 4.0, 15.0, 10.0, 15.0, 20.0, 12.0]
CLASS_TYPICAL_M = [(3, 2, 10), (3, 2, 10), (3, 2, 10), (8, 2, 25), (9, 4, 15), (18, 8, 25), (22, 10, 30), (10, 4, 30)]


def knife_edge(nu: Column) -> Column:
    """Loss over one edge; nothing below -0.78."""
    return F.when(nu <= -0.78, F.lit(0.0)).otherwise(6.9 + 20.0 * F.log10(F.sqrt(F.pow(nu - 0.1, F.lit(2.0)) + 1.0) + nu - 0.1))


def free_space_km(mhz: Column, km: Column) -> Column:
    return 32.44 + 20.0 * F.log10(mhz) + 20.0 * F.log10(F.greatest(km, F.lit(1e-9)))


def _inner(d: Column, ground: Column) -> Column:
    """The profile without its two ends, as structs d, g."""
    n = F.greatest(F.size(d) - 2, F.lit(0))
    return F.zip_with(F.slice(d, F.lit(2), n), F.slice(ground, F.lit(2), n), lambda a, b: F.struct(a.alias("d"), b.alias("g")))


def near_field_loss(mhz: Column, d: Column, bare: Column, ground: Column, tx_m: Column, rx_m: Column) -> Column:
    """Free space plus the single worst edge of a short path; null for fewer than three points or no length."""
    length = F.element_at(d, -1)
    tx, rx = F.get(bare, F.lit(0)) + tx_m, F.element_at(bare, -1) + rx_m

    def nu(p: Column) -> Column:
        h = p["g"] - (tx + (rx - tx) * (p["d"] / length))
        detour = F.hypot(p["d"], h) + F.hypot(length - p["d"], h) - length
        return F.signum(h) * F.sqrt(4.0 * F.abs(detour) / (LIGHT_M_US / mhz))

    inside = F.filter(_inner(d, ground), lambda p: (p["d"] > 0) & (p["d"] < length))
    worst = F.array_max(F.transform(inside, nu))
    return F.when((F.size(d) >= 3) & (length > 0), free_space_km(mhz, length / 1000.0) + F.coalesce(F.greatest(knife_edge(worst), F.lit(0.0)), F.lit(0.0)))


def fresnel_ratio(mhz: Column, d: Column, bare: Column, ground: Column, tx_m: Column, rx_m: Column, step_m: float, lapse: float = 45.0) -> Column:
    """The least clearance in radii of the first Fresnel zone, away from the terminals; 0 if no point counts."""
    wave, length = LIGHT_M_US / mhz, F.element_at(d, -1)
    earth = 157.0 / max(157.0 - lapse, 1e-6) * 6_371_000.0
    tx, rx = F.get(bare, F.lit(0)) + tx_m, F.element_at(bare, -1) + rx_m
    margin = F.greatest(step_m * step_m / wave, F.lit(30.0))

    def ratio(p: Column) -> Column:
        left = length - p["d"]
        ray = tx + (rx - tx) * (p["d"] / length)
        return (ray - (p["g"] + p["d"] * left / (2.0 * earth))) / F.sqrt(wave * p["d"] * left / length)

    inside = F.filter(_inner(d, ground), lambda p: (p["d"] >= margin) & (length - p["d"] >= margin))
    return F.coalesce(F.array_min(F.transform(inside, ratio)), F.lit(0.0))


def clearance(ratio: Column) -> Column:
    return F.when(ratio >= 0.6, "clear").when(ratio >= 0, "grazing").otherwise("obstructed")


def height_gain(ghz: Column, height: Column, clutter: Column, street: Column, obstructed: Column) -> Column:
    """Loss of a terminal below its clutter; null outside 0.03 to 3 GHz."""
    wide = F.when(street > 0.1, street).otherwise(F.lit(27.0))
    rise = clutter - height
    nu = 0.342 * F.sqrt(ghz) * F.sqrt(rise * F.degrees(F.atan(rise / wide)))
    among = F.greatest(knife_edge(nu) - 6.03, F.lit(0.0))
    open_ = F.greatest(-(21.8 + 6.2 * F.log10(ghz)) * F.log10(F.greatest(height, F.lit(0.1)) / clutter), F.lit(0.0))
    return F.when(ghz.between(0.03, 3.0), F.when(height >= clutter, F.lit(0.0)).otherwise(F.when(obstructed, among).otherwise(open_)))


def estimated_height(operator_m: Column, building_m: Column, clutter_m: Column, cls: Column, ceiling_m: float = 30.0) -> Column:
    """struct(m, basis): stated by the operator; else a building's top and 2 m mast; else clutter; else the class's typical height; else 8 m. All but the first stay under the ceiling."""
    typical = F.get(F.array(*[F.lit(float(t)) for t, _, _ in CLASS_TYPICAL_M]), cls)
    pick = lambda m, basis: F.struct(F.least(m, F.lit(ceiling_m)).alias("m"), F.lit(basis).alias("basis"))
    stated = F.struct(operator_m.alias("m"), F.lit("operator").alias("basis"))
    return F.when(operator_m.isNotNull(), stated).when(building_m.isNotNull(), pick(building_m + 2.0, "building")).when(clutter_m > 0, pick(clutter_m, "clutter")).when(typical.isNotNull(), pick(typical, "class")).otherwise(pick(F.lit(8.0), "none"))


def power_curve(points: list[tuple[int, int]], chip: Column) -> Column:
    """What a front end makes of a chip power: straight lines between whole points, halves away from zero, flat outside."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        rise = (y1 - y0) * (chip - x0)
        out = F.when(chip <= x1, y0 + (F.signum(rise) * F.floor((F.abs(rise) + (x1 - x0) // 2) / (x1 - x0))).cast("int")).otherwise(out)
    return F.when(chip <= points[0][0], F.lit(points[0][1])).otherwise(out)
