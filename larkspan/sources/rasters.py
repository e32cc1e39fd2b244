"""Georeferenced TIFF rasters: a row per tile or strip, windows, samples, and a writer.

Read: tiled or striped, one sample a pixel, 8 or 16 bit integers and floats, stored plainly or deflated, predictors 1 to 3.
Anything else is a ValueError that names the tag. Palette rasters give their indices.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the format: bytes of the field types, tags, geo keys.
SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
RASTER_TYPE, POINT = 1025, 2
BLOCKS = "path string, x0 double, y0 double, step_x double, step_y double, width int, height int, row0 int, col0 int, rows int, cols int, v array<double>"


def tags(content: bytes) -> tuple[str, dict[int, list]]:
    """The byte order and the first image's fields."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("the file doesn't begin as a TIFF")
    at = struct.unpack_from(order + "I", content, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", content, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", content, entry)
        if kind not in SIZES:
            continue
        code, size = SIZES[kind]
        place = entry + 8 if n * size <= 4 else struct.unpack_from(order + "I", content, entry + 8)[0]
        if kind == 2:
            out[tag] = [content[place : place + n].split(b"\0")[0].decode("latin-1")]
        else:
            out[tag] = list(struct.unpack_from(f"{order}{n * len(code)}{code[0]}", content, place))
    return order, out


def _dtype(t: dict[int, list], order: str) -> np.dtype:
    kind = {1: "u", 2: "i", 3: "f"}.get(t.get(FORMAT, [1])[0])
    bits = t.get(BITS, [1])[0]
    if t.get(SAMPLES, [1])[0] != 1 or kind is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"unsupported pixels: {t.get(SAMPLES)} samples, format {t.get(FORMAT)}, {bits} bits")
    return np.dtype(f"{order}{kind}{bits // 8}")


def _origin(t: dict[int, list]) -> tuple[float, float, float, float]:
    """The centre of cell 0, 0 and the step to the next column and row."""
    if PIXEL_SCALE not in t or TIEPOINT not in t:
        raise ValueError("no pixel scale or tie point")
    sx, sy = t[PIXEL_SCALE][:2]
    i, j, _, x, y = t[TIEPOINT][:5]
    keys = t.get(GEO_KEYS, [])
    point = any(keys[k] == RASTER_TYPE and keys[k + 3] == POINT for k in range(4, len(keys) - 3, 4))
    half = 0.0 if point else 0.5
    return x + (half - i) * sx, y - (half - j) * sy, sx, -sy


def _block(raw: bytes, t: dict[int, list], dtype: np.dtype, rows: int, cols: int) -> np.ndarray:
    packed = t.get(COMPRESSION, [1])[0]
    if packed in (8, 32946):
        raw = zlib.decompress(raw)
    elif packed != 1:
        raise ValueError(f"unsupported compression {packed}")
    size, predictor = dtype.itemsize, t.get(PREDICTOR, [1])[0]
    if len(raw) < rows * cols * size:
        raise ValueError("a block is cut off")
    if predictor == 3:  # differences of bytes, the most significant bytes of a row first
        flat = np.frombuffer(raw, "u1", rows * cols * size).reshape(rows, cols * size)
        planes = np.cumsum(flat, axis=1, dtype="u1").reshape(rows, size, cols)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols)
    out = np.frombuffer(raw, dtype, rows * cols).reshape(rows, cols)
    if predictor == 2:
        return np.cumsum(out, axis=1, dtype=dtype.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"unsupported predictor {predictor}")
    return out


def blocks_of(content: bytes) -> Iterator[tuple]:
    """x0, y0, step_x, step_y, width, height, row0, col0 and the values of each block, cells without data as nan."""
    order, t = tags(content)
    dtype, where = _dtype(t, order), _origin(t)
    width, height = t[WIDTH][0], t[HEIGHT][0]
    tiled = TILE_AT in t
    cols, rows = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(STRIP_ROWS, [height])[0], height))
    starts, sizes = (t[TILE_AT], t[TILE_BYTES]) if tiled else (t[STRIP_AT], t[STRIP_BYTES])
    across = -(-width // cols)
    none = float(t[NO_DATA][0]) if NO_DATA in t and t[NO_DATA][0].strip() else None
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        row0, col0 = k // across * rows, k % across * cols
        held = min(rows, height - row0)
        if size == 0:  # a sparse block holds no data
            v = np.full((held, min(cols, width - col0)), np.nan)
        else:
            v = _block(content[at : at + size], t, dtype, rows if tiled else held, cols)[:held, : width - col0].astype("f8")
            if none is not None:
                v[v == none] = np.nan
        yield *where, width, height, row0, col0, v


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for f in frames:
        for path, content in zip(f["path"], f["content"], strict=True):
            for *head, v in blocks_of(content):  # a block at a time leaves the task
                yield pd.DataFrame([(path, *head, *v.shape, v.ravel())], columns=names)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A row per tile or strip of every raster under path: where it lies and its values, row by row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    return files.select("path", "content").mapInPandas(_rows, BLOCKS)


def cells(blocks: DataFrame) -> DataFrame:
    """path, row, col, x, y (a cell's centre), v; cells without data are left out."""
    each = blocks.select("path", "x0", "y0", "step_x", "step_y", "row0", "col0", "cols", F.posexplode("v").alias("k", "v")).filter("v IS NOT NULL AND NOT isnan(v)")
    row, col = F.col("row0") + F.floor(F.col("k") / F.col("cols")).cast("int"), F.col("col0") + F.col("k") % F.col("cols")
    return each.select("path", row.alias("row"), col.alias("col"), "x0", "y0", "step_x", "step_y", "v").select("path", "row", "col", (F.col("x0") + F.col("col") * F.col("step_x")).alias("x"), (F.col("y0") + F.col("row") * F.col("step_y")).alias("y"), "v")


def window(blocks: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The cells from the ones nearest the corners, inclusive. The low side is held at 0; a corner beyond the far side leaves the raster out."""
    near = lambda v, o, s: F.floor((F.lit(v) - F.col(o)) / F.col(s) + 0.5)
    held = blocks.withColumn("_c0", F.greatest(F.lit(0), near(west, "x0", "step_x"))).withColumn("_c1", near(east, "x0", "step_x")).withColumn("_r0", F.greatest(F.lit(0), near(north, "y0", "step_y"))).withColumn("_r1", near(south, "y0", "step_y"))
    held = held.filter((F.col("_c1") < F.col("width")) & (F.col("_r1") < F.col("height")))
    held = held.filter("row0 <= _r1 AND row0 + rows > _r0 AND col0 <= _c1 AND col0 + cols > _c0")  # whole blocks go before any cell is made
    bounds = held.select("path", "_c0", "_c1", "_r0", "_r1").distinct()
    return cells(held).join(bounds, "path").filter("row BETWEEN _r0 AND _r1 AND col BETWEEN _c0 AND _c1").drop("_c0", "_c1", "_r0", "_r1")


def encode(v: np.ndarray, west: float, north: float, step: float, epsg: int) -> bytes:
    """A float raster in strips of about 8 KB; nan marks cells without data. west, north: the outer corner."""
    height, width = v.shape
    rows = max(1, 8192 // (4 * width))
    strips = [v[r : r + rows].astype("<f4").tobytes() for r in range(0, height, rows)]
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, RASTER_TYPE, 0, 1, 1, 3072, 0, 1, epsg]
    at = 8
    starts = []
    for s in strips:
        starts.append(at)
        at += len(s)
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [32]), (COMPRESSION, "H", [1]), (262, "H", [1]), (STRIP_AT, "I", starts), (SAMPLES, "H", [1]), (STRIP_ROWS, "I", [rows]),
        (STRIP_BYTES, "I", [len(s) for s in strips]), (FORMAT, "H", [3]), (PIXEL_SCALE, "d", [step, step, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (GEO_KEYS, "H", keys), (NO_DATA, "c", b"nan\0"),
    ]
    kinds = {"H": 3, "I": 4, "d": 12, "c": 2}
    entries, extra, after = [], b"", at + 2 + 12 * len(fields) + 4
    for tag, code, values in fields:
        data = values if code == "c" else struct.pack(f"<{len(values)}{code}", *values)
        if len(data) > 4:
            place = struct.pack("<I", after + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, kinds[code], len(values)) + place)
    return b"".join([struct.pack("<2sHI", b"II", 42, at), *strips, struct.pack("<H", len(fields)), *entries, b"\0\0\0\0", extra])
