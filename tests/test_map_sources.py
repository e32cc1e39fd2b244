"""Rasters, layers, city models, node lists and street-map elements, on small files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import feeds as ops
from larkspan.operators import mapdata
from larkspan.sources import buildings, feeds, layers, rasters


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def tiff(v, tile, code, form, compression, predictor, keys=()):
    """A tiled big-endian raster, packed here by other code than the reader's."""
    rows, cols = v.shape
    blocks = []
    for r in range(0, rows, tile):
        for c in range(0, cols, tile):
            block = np.zeros((tile, tile), v.dtype)
            part = v[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1].copy()
            raw = block.astype(block.dtype.newbyteorder(">")).tobytes()
            if predictor == 3:
                size, lines = v.dtype.itemsize, []
                for k in range(tile):
                    line = raw[k * tile * size : (k + 1) * tile * size]
                    planes = b"".join(line[b::size] for b in range(size))
                    lines.append(bytes([planes[0]]) + bytes((planes[i] - planes[i - 1]) % 256 for i in range(1, len(planes))))
                raw = b"".join(lines)
            blocks.append(zlib.compress(raw) if compression == 8 else raw)
    starts, at = [], 8
    for b in blocks:
        starts.append(at)
        at += len(b)
    fields = [(256, "H", [cols]), (257, "H", [rows]), (258, "H", [v.dtype.itemsize * 8]), (259, "H", [compression]), (277, "H", [1]), (317, "H", [predictor]), (322, "H", [tile]), (323, "H", [tile]), (324, "I", starts), (325, "I", [len(b) for b in blocks]), (339, "H", [form]), (33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0, 0, 0, 1000.0, 2000.0, 0]), (34735, "H", list(keys) or [1, 1, 0, 0])]
    entries, extra, after = b"", b"", at + 2 + 12 * len(fields) + 4
    for t, c, values in fields:
        data = struct.pack(f">{len(values)}{c}", *values)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", after + len(extra))
        extra += data if len(data) > 4 else b""
        entries += struct.pack(">HHI", t, {"H": 3, "I": 4, "d": 12}[c], len(values)) + place
    return struct.pack(">2sHI", b"MM", 42, at) + b"".join(blocks) + struct.pack(">H", len(fields)) + entries + b"\0" * 4 + extra


def whole(content):
    out = None
    for _, _, _, _, width, height, r, c, v in rasters.blocks_of(content):
        out = np.full((height, width), -1.0) if out is None else out
        out[r : r + v.shape[0], c : c + v.shape[1]] = v
    return out


@pytest.mark.parametrize("kind,form,predictor", [("u1", 1, 1), ("i2", 2, 2), ("u2", 1, 2), ("f4", 3, 1), ("f4", 3, 3), ("f8", 3, 3)])
@pytest.mark.parametrize("compression", [1, 8])
def test_tiles(kind, form, predictor, compression):
    rng = np.random.default_rng(5)
    v = (rng.random((37, 53)) * 200).astype(kind)
    assert np.array_equal(whole(tiff(v, 16, kind, form, compression, predictor)), v.astype("f8"))


def test_rasters(spark, tmp_path):
    v = np.arange(700 * 9, dtype="f4").reshape(700, 9)
    v[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(rasters.encode(v, 1000.0, 9000.0, 10.0, 25833))
    blocks = rasters.read_blocks(spark, str(tmp_path))
    assert blocks.count() > 1 and blocks.agg(F.sum("rows")).first()[0] == 700
    cells = rasters.cells(blocks)
    assert cells.count() == v.size - 1
    assert cells.filter("row = 600 AND col = 7").select("x", "y", "v").first() == (1075.0, 2995.0, float(v[600, 7]))
    held = rasters.window(blocks, 900.0, 8950.0, 1026.0, 8994.0).select("row", "col", "v").collect()
    assert {(r.row, r.col): r.v for r in held} == {(r, c): float(v[r, c]) for r in range(6) for c in range(3)}
    assert rasters.window(blocks, 900.0, 8950.0, 2000.0, 8994.0).count() == 0
    point = tiff(v[:20], 16, "f4", 3, 1, 1, keys=[1, 1, 0, 1, 1025, 0, 1, 2])
    assert next(rasters.blocks_of(point))[:4] == (1000.0, 2000.0, 10.0, -10.0)
    for bad in (b"nothing", b"II\x2b\x00" + b"\0" * 20):
        with pytest.raises(ValueError):
            list(rasters.blocks_of(bad))


def test_layers(spark, tmp_path):
    nodes = [("a", "ä" * 200, "repeater", 1.5, 2.5, None, 22.0, None), ("b", "", "room", -1.0, 0.0, 12.0, None, 0)]
    content = layers.encode_nodes(nodes)
    (tmp_path / "nodes.bin").write_bytes(content)
    got = layers.read_nodes(spark, str(tmp_path / "nodes.bin")).drop("path").collect()
    assert [tuple(r) for r in got] == [("a", "ä" * 127, *nodes[0][2:]), nodes[1]]
    for bad in (b"XXXX" + content[4:], content[:-1], content[:8] + b"\x09" + content[9:]):
        with pytest.raises(ValueError):
            list(layers.nodes_of(bad))
    with pytest.raises(ValueError):
        layers.encode_nodes([("a", "", "room", float("nan"), 0.0, None, None, None)])
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    (tmp_path / "places.bin").write_bytes(layers.encode_places([("city", "Ulm", "", 1.0, 2.0, None), ("street", "Weg", "89073", 1.0, 2.0, 0)], [("89073", [ring, ring[:2]])]))
    places = layers.read_places(spark, str(tmp_path / "places.bin")).collect()
    assert [(r.kind, r.name, r.ctx, r.area) for r in places] == [("city", "Ulm", "", None), ("street", "Weg", "89073", 0)]
    area = layers.read_areas(spark, str(tmp_path / "places.bin")).first()
    assert (area.area, area.code, [[tuple(p) for p in r] for r in area.rings]) == (0, "89073", [ring, ring[:2]])
    (tmp_path / "roads.bin").write_bytes(layers.encode_roads([("rail", ring), ("motorway", [])]))
    roads = layers.read_roads(spark, str(tmp_path / "roads.bin")).collect()
    assert [(r.way, r["class"], len(r.points)) for r in roads] == [(0, "rail", 3), (1, "motorway", 0)]


def building(ident, height, rings, inner=""):
    polygons = "".join(f"<g:Polygon><g:exterior><g:LinearRing><g:posList>{r}</g:posList></g:LinearRing></g:exterior>{inner}</g:Polygon>" for r in rings)
    return f'<b:measuredHeight>{height}</b:measuredHeight><b:boundedBy><b:GroundSurface>{polygons}</b:GroundSurface></b:boundedBy>'


def test_city_models(spark, tmp_path):
    square = "0 0 30 10 0 30 10 10 34 0 10 34 0 0 30"
    hole = "<g:interior><g:LinearRing><g:posList>2 2 30 4 2 30 4 4 30 2 4 30</g:posList></g:LinearRing></g:interior>"
    part = f'<b:consistsOfBuildingPart><b:BuildingPart g:id="p">{building("p", 7, [square])}</b:BuildingPart></b:consistsOfBuildingPart>'
    bodies = [("a", building("a", 12.5, [square], hole) + part), ("low", building("low", 0, [square])), ("tiny", building("tiny", 3, ["0 0 1 1 0 1 0 1 1"])), ("bad", building("bad", "tall", [square])), ("flat", "<b:measuredHeight>4</b:measuredHeight>")]
    xml = '<m xmlns:b="urn:b" xmlns:g="urn:g">' + "".join(f'<b:Building g:id="{i}">{x}</b:Building>' for i, x in bodies) + "</m>"
    write(tmp_path / "model.gml", xml)
    records = buildings.read_city_models(spark, str(tmp_path / "model.gml"))
    got = {r.id: r for r in records.collect()}
    assert set(got) == {"a", "p"}
    assert got["p"].area_m2 == pytest.approx(100) and (got["p"].e, got["p"].n) == pytest.approx((5, 5)) and got["p"].ground_z == pytest.approx(31.6)
    assert got["a"].area_m2 == pytest.approx(96) and got["a"].e == pytest.approx((500 - 12) / 96) and len(got["a"].rings[0].interiors) == 1
    buildings.building_lines(records).write.text(str(tmp_path / "lines"))
    assert {r.id: r for r in buildings.read_buildings(spark, str(tmp_path / "lines")).collect()} == got
    old = write(tmp_path / "old.jsonl", '{"id":"x","e":1,"n":2,"ground_z":3,"area_m2":4,"height_m":5}\n{"id":"cut"\n')
    assert [(r.id, r.source, r.rings) for r in buildings.read_buildings(spark, old).collect()] == [("x", "lod2", [])]


def test_node_list(spark, tmp_path):
    now, day = 1_788_134_400, 86_400
    base = {"latitude": 52.5, "longitude": 13.4, "last_heard": now - day, "role": "CLIENT"}
    rows = [{"node_id": f"!{k}", "num": k, **base, **more} for k, more in enumerate([{}, {"role": "COMPANION"}, {"latitude": None}, {"latitude": 0, "longitude": 0}, {"precision_bits": 16}, {"latitude": 40}, {"last_heard": now + 8 * day}, {"last_heard": now - 91 * day}, {"last_heard": None}, {"role": "ROOM_SERVER", "protocol": "MeshCore"}, {"precision_bits": 32}])]
    rows.append({"node_id": "!0", "num": 0, **base, "longitude": 13.5, "location_source": "LOC_MANUAL", "long_name": "  ", "short_name": "x"})
    nodes = feeds.read_node_list(spark, write(tmp_path / "nodes.json", json.dumps(rows))).orderBy("row")
    box = (13.033, 52.310, 13.810, 52.710)
    got = ops.list_bucketed(nodes, box, now).orderBy("row").collect()
    assert [r.bucket for r in got] == ["kept", "wrong kind", "no position", "no position", "truncated", "outside", "future", "stale", "no stamp", "kept", "kept", "kept"]
    assert [got[i].quality for i in (0, 2, 9, 10, 11)] == ["unknown", "unknown", "fixed", "gps", "fixed"] and got[9].kind == "room-server" and got[11].name == "x"
    assert ops.list_bucketed(nodes, None, now, None, None, True).filter("bucket = 'kept'").count() == 9
    heard = feeds.read_neighbours(spark, write(tmp_path / "n.json", json.dumps([{"node_id": "!0", "neighbor_id": "!9", "snr": -3.5, "rx_time": 5}, {"node_id": "!404", "neighbor_id": "!0"}])), nodes)
    assert sorted((r.tx, r.rx, r.tx_lon, r.rx_lon, r.quality, r.snr) for r in heard.collect()) == [("!0", "!404", 13.5, None, "unknown", None), ("!9", "!0", 13.4, 13.5, "fixed", -3.5)]
    traced = feeds.read_traces(spark, write(tmp_path / "t.json", json.dumps([{"src": 9, "dest": 10, "rssi": -90, "snr": 2}, {"src": 9, "dest": 404}, {"dest": 9}])), nodes)
    assert [(r.tx, r.rx, r.quality, r.rssi) for r in traced.collect()] == [("!9", "!10", "gps", -90.0)]


def test_hop_reports_and_maps(spark, tmp_path):
    for k, line in enumerate(["paths 5, by hops: 1:3 2:2", "by hops: 2:4", "by hops:"]):
        write(tmp_path / f"r{k}.txt", f"other\n{line}\n")
    assert sorted(tuple(r) for r in feeds.read_hop_reports(spark, f"{tmp_path}/r*.txt").collect()) == [(1, 3), (2, 6)]
    grid = write(tmp_path / "map.txt", "1 2 3\n4 5 6\n")
    assert {(r.row, r.col): r.v for r in feeds.read_refractivity(spark, grid, 2, 3).collect()} == {(r, c): 3.0 * r + c + 1 for r in range(2) for c in range(3)}
    with pytest.raises(Exception, match="isn't 2 by 2"):
        feeds.read_refractivity(spark, grid, 2, 2).collect()


def test_map_elements(spark):
    tags = "map<string, string>"
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {"place": "hamlet", "name": "A"}), (2, 0.0, 1.0, {"place": "farm", "name": "B"}), (3, 1.0, 1.0, {"natural": "peak"}), (4, None, 1.0, {})], f"id long, lat double, lon double, tags {tags}")
    ways = spark.createDataFrame([(10, [2, 1, 9, 4, 3, 2], {"building": "yes", "highway": "primary_link"}), (11, [1, 2], {}), (12, [1], {"building": "no"}), (13, [9], {"railway": "subway"})], f"id long, refs array<long>, tags {tags}")
    member = "array<struct<type: string, ref: long, role: string>>"
    relations = spark.createDataFrame([(20, [("way", 10, "outer"), ("node", 1, ""), ("way", 11, "inner"), ("way", 99, "outer")], {"type": "multipolygon", "building": "church"}), (21, [("way", 10, "outer")], {"type": "route"}), (22, [], {"boundary": "postal_code"})], f"id long, members {member}, tags {tags}")
    got = {r.id: r for r in mapdata.resolved_ways(nodes, ways, relations).collect()}
    assert set(got) == {10, 13} and got[10].tags == {"highway": "primary_link"} and [tuple(p) for p in got[10].points] == [(0, 1), (0, 0), (1, 1), (0, 1)] and got[13].points == []
    rels = {r.id: r for r in mapdata.resolved_relations(nodes, ways, relations).collect()}
    assert {k: [(m.role, len(m.points)) for m in r.members] for k, r in rels.items()} == {20: [("outer", 4), ("inner", 2)], 22: []}
    assert [(r.id, r.kind) for r in mapdata.named_points(nodes).collect()] == [(1, "village")]
    assert [r[0] for r in ways.orderBy("id").select(mapdata.road_class()).collect()] == ["primary", None, None, "rail"]


def test_building_heights(spark):
    cases = [({"height": "12,5 m;3"}, 12.5, "height"), ({"height": "40'6\""}, 12.3444, "height"), ({"height": "10 ft"}, 3.048, "height"), ({"height": "0", "building:levels": "3"}, 11.0, "levels"), ({"building:levels": "2.6;9", "roof:shape": "flat"}, 9.0, "levels"), ({"building:levels": "0"}, 9.0, "default"), ({"building": "garage", "height": "tall"}, 3.0, "default"), ({"building": "no", "height": "3"}, None, None)]
    rows = spark.createDataFrame([(i, {"building": "yes", **t}) for i, (t, _, _) in enumerate(cases)], "i int, tags map<string, string>")
    got = rows.select("i", mapdata.building_height().alias("h")).orderBy("i").collect()
    for (t, metres, source), r in zip(cases, got, strict=True):
        assert (r.h and r.h.source) == source and (r.h and r.h.height_m) == (pytest.approx(metres) if metres else None), t
