"""Building records: city models in XML, and the JSON lines they are kept as."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINT = "struct<x: double, y: double>"
RINGS = f"array<struct<exterior: array<{POINT}>, interiors: array<array<{POINT}>>>>"
RECORD = f"id string, e double, n double, ground_z double, area_m2 double, height_m double, source string, rings {RINGS}"
COLUMNS = ["id", "e", "n", "ground_z", "area_m2", "height_m", "source", "rings"]
MIN_AREA_M2 = 1.0


def area_centroid(ring: list[tuple[float, float]]) -> tuple[float, float, float]:
    """A ring's area and centroid, taken about its first point so that large coordinates keep their digits."""
    if len(ring) < 3:
        return 0.0, 0.0, 0.0
    ox, oy = ring[0]
    twice = cx = cy = 0.0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        ax, ay, bx, by = ax - ox, ay - oy, bx - ox, by - oy
        cross = ax * by - bx * ay
        twice += cross
        cx += (ax + bx) * cross
        cy += (ay + by) * cross
    if twice == 0:
        return 0.0, ox, oy
    return abs(twice) / 2, ox + cx / (3 * twice), oy + cy / (3 * twice)


class _Open:
    """A building or a part of one while its element is open."""

    def __init__(self, ident: str) -> None:
        self.ident, self.height = ident, math.nan
        self.rings: list[tuple[list, list]] = []
        self.ground: list[float] = []

    def add(self, numbers: list[float], inner: bool) -> None:
        if len(numbers) < 9 or len(numbers) % 3:
            return
        self.ground += numbers[2::3]
        ring = list(zip(numbers[::3], numbers[1::3], strict=True))
        if inner and self.rings:
            self.rings[-1][1].append(ring)
        else:
            self.rings.append((ring, []))

    def record(self) -> tuple | None:
        if not self.height > 0 or not self.rings:
            return None
        area = e = n = 0.0
        for outer, holes in self.rings:
            for ring, sign in [(outer, 1), *[(h, -1) for h in holes]]:
                a, x, y = area_centroid(ring)
                area, e, n = area + sign * a, e + sign * a * x, n + sign * a * y
        if area < MIN_AREA_M2:
            return None
        points = lambda ring: [{"x": x, "y": y} for x, y in ring]
        rings = [{"exterior": points(o), "interiors": [points(h) for h in hs]} for o, hs in self.rings]
        return self.ident, e / area, n / area, sum(self.ground) / len(self.ground), area, self.height, "lod2", rings


def records_of(content: bytes) -> Iterator[tuple]:
    """The buildings and building parts of a city model, each from its own elements. No measured height, no ground or under 1 m2: no record."""
    held: list[_Open] = []
    path: list[str] = []
    for event, el in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        name = el.tag.rsplit("}", 1)[-1]
        if event == "start":
            path.append(name)
            if name in ("Building", "BuildingPart"):
                held.append(_Open(next((v for k, v in el.attrib.items() if k.rsplit("}", 1)[-1] == "id"), "")))
            continue
        path.pop()
        if held and name == "measuredHeight":
            try:
                held[-1].height = float(el.text or "")
            except ValueError:
                pass  # an unreadable height leaves the one before
        elif held and name == "posList" and "GroundSurface" in path:
            try:
                held[-1].add([float(v) for v in (el.text or "").split()], "interior" in path)
            except ValueError:
                pass  # a ring with a word in it is no ring
        elif name in ("Building", "BuildingPart"):
            if (row := held.pop().record()) is not None:
                yield row
            el.clear()


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for content in f["content"]:
            held = []
            for row in records_of(content):
                held.append(row)
                if len(held) == 1024:
                    yield pd.DataFrame(held, columns=COLUMNS)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=COLUMNS)


def read_city_models(spark: SparkSession, path: str) -> DataFrame:
    """A building record per building and part of every model under path (a model is one tile's file)."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_rows, RECORD)


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """Building records from JSON lines, rings as pairs of numbers. Without a source a record came from a city model; lines that aren't records are left out."""
    schema = StructType.fromDDL("id string, e double, n double, ground_z double, area_m2 double, height_m double, source string, rings array<struct<exterior: array<array<double>>, interiors: array<array<array<double>>>>>")
    rows = spark.read.schema(schema).json(path).filter("id IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND height_m IS NOT NULL")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    ring = lambda r: F.transform(r, point)
    polygon = lambda g: F.struct(ring(g["exterior"]).alias("exterior"), F.transform(F.coalesce(g["interiors"], F.array().cast("array<array<array<double>>>")), ring).alias("interiors"))
    rings = F.coalesce(F.transform("rings", polygon), F.array().cast(RINGS))
    return rows.withColumn("source", F.coalesce("source", F.lit("lod2"))).withColumn("rings", rings)


def building_lines(records: DataFrame, with_rings: bool = True) -> DataFrame:
    """value: a JSON line per record, for DataFrameWriter.text."""
    pair = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, pair)
    polygon = lambda g: F.struct(ring(g["exterior"]).alias("exterior"), F.transform(g["interiors"], ring).alias("interiors"))
    held = ["id", "e", "n", "ground_z", "area_m2", "height_m", "source"]
    return records.select(F.to_json(F.struct(*held, *([F.transform("rings", polygon).alias("rings")] if with_rings else []))).alias("value"))
