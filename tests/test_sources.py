"""Readers on small files, with the rows they must drop."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import medium
from larkspan.sources import feeds, loss_table, record


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def run(tmp_path):
    lines = ["# a record"]
    put = lambda at, way, sid, msg: lines.append(f"{at:.6f}\t{way}\t{sid}\t{json.dumps(msg)}")
    put(0.0, "out", 1, {"type": "welcome", "epoch": 1_790_000_000_000_000, "t": 0})
    for k, (sid, t0, span, freq) in enumerate([(1, 2.0, 0.2, 869_525_000), (2, 3.0, 0.2, 869_525_000), (2, 5.0, 0.1, 869_100_000)]):
        put(t0, "in", sid, {"type": "tx", "t0": int(t0 * 1e6), "t_end": int((t0 + span) * 1e6), "freq": freq, "bw": 125_000, "sf": 8, "power_dbm": 14, "payload": f"p{k}"})
        put(t0, "out", 3, {"type": "rx_begin", "id": k, "t0": int(t0 * 1e6), "t_end": int((t0 + span) * 1e6)})
        put(t0 + span, "out", 3, {"type": "rx_end", "id": k, "verdict": "crc" if k == 1 else "clean", "payload": f"p{k}", "t": int((t0 + span) * 1e6)})
    lines += ["1.0\tin\tx\t{}", "1.0\tin\t1", "1.0\tin\t1\t{bad", "1.0\tin\t1\t{}\textra", "2026-09-25T10:00:01.5Z\tin\t1\t" + json.dumps({"type": "state", "mode": "RX"})]
    return write(tmp_path / "record.tsv", "\n".join(lines) + "\n")


def test_record(spark, run):
    r = record.read_record(spark, run)
    assert r.count() == 11
    assert record.epoch(r).first()[0] == 1_790_000_000_000_000
    assert record.last_instant(r).first()[0] == 5_100_000
    assert record.transmissions(r).agg(F.sum(F.col("t1") - F.col("t0"))).first()[0] == 500_000
    assert sorted((x.tx, x.verdict) for x in record.received(r).collect()) == [(1, "clean"), (2, "clean"), (2, "crc")]
    assert record.read_record(spark, run, ["tx"]).count() == 3
    assert r.filter("msg.type = 'state'").first().at == 36_001.5
    line = record.record_lines(r.filter("msg.type = 'tx'").orderBy("line_no").limit(1)).first()[0]
    assert line.startswith("2.000000\tin\t1\t{") and list(json.loads(line.split("\t")[3])) == sorted(json.loads(line.split("\t")[3]))


def test_loss_tables(spark, tmp_path):
    n = 7
    loss, flags, samples = np.arange(n * n, dtype="f4"), np.arange(n * n) % 32, np.arange(n * n) * 3
    loss[3] = np.inf
    whole = loss_table.encode({"nodes": [f"n{i}" for i in range(n)]}, loss, flags, samples)
    (tmp_path / "868.bin").write_bytes(whole)
    got = {(r.a, r.b): (r.loss, r.flags, r.samples) for r in loss_table.read_loss_tables(spark, str(tmp_path)).collect()}
    assert got["n1", "n2"] == (9.0, 9, 27) and got["n0", "n3"][0] == float("inf") and len(got) == n * n
    for bad in (b"XXXX" + whole[4:], whole[:-1], loss_table.encode({"nodes": ["a"]}, loss[:4], flags[:4], samples[:4])[:20]):
        with pytest.raises(Exception):  # noqa: B017
            loss_table.decode(bad)


def test_loss_tables_in_parts(spark, monkeypatch):
    """No part holds a whole table; sorted by where they begin, the parts are the file; pairs that weren't heard, and strips without any, are in it."""
    monkeypatch.setattr(loss_table, "STRIP", 16)
    rows = [("868", f"n{i}", f"n{j}", float(i * 10 + j), (i + j) % 32, i * j) for i in range(9) for j in range(9) if i != j and i not in (2, 3, 8)] + [("433", "x", "y", 5.0, 1, 2)]
    parts = loss_table.encoded_parts(spark.createDataFrame(rows, loss_table.CELLS)).cache()
    held = parts.collect()
    assert max(len(x) for r in held if r.at[0] for x in r.content) <= 4 * 16 and len(held) > 10
    for band in ("868", "433"):
        whole = b"".join(bytes(x) for _, x in sorted((at, x) for r in held if r.band == band for at, x in zip(r.at, r.content)))
        header, loss, flags, samples = loss_table.decode(whole)
        names = header["nodes"]
        want = {(a, b): (x, f, s) for c, a, b, x, f, s in rows if c == band}
        assert names == sorted({x for pair in want for x in pair}) and whole == loss_table.encode(header, loss, flags, samples)
        assert [(x, int(f), int(s)) for x, f, s in zip(loss.tolist(), flags, samples)] == [want.get((a, b), (np.inf, 0, 0)) for a in names for b in names]
        back = {(r.a, r.b): (r.loss, r.flags, r.samples) for r in loss_table.decoded_parts(parts).collect() if r.band == band}
        assert len(back) == len(names) ** 2 and {k: v for k, v in back.items() if v[0] < np.inf} == want


def test_computed_loss_tables(spark, monkeypatch):
    """Tables computed by strips are the file that encode() gives, a name listed twice included; their cells come back from pieces of rows."""
    for what, cells in (("COMPUTED", 16), ("PIECE", 4), ("TASK_STRIPS", 2)):
        monkeypatch.setattr(loss_table, what, cells)
    keys = {"868": [0, 1, 2, 3, 4, 5, 5, 10, 11], "433": [7]}
    values = lambda i, j: (np.where(i == j, np.inf, i * 10.0 + j), (i + j) * 10 + 20, i * 5900 + j)
    parts = loss_table.computed_parts(spark.createDataFrame([(band, f"n{k}", k) for band, x in keys.items() for k in x], "band string, name string, key long"), values).cache()
    held, back = parts.collect(), loss_table.decoded_parts(parts).collect()
    assert max(len(x) for r in held if not r.head for x in r.content) <= 4 * 16 and len(held) > 10
    for band, x in keys.items():
        x = np.array(sorted(x, key=lambda k: f"n{k}"))
        whole = b"".join(bytes(c) for _, c in sorted((at, c) for r in held if r.band == band for at, c in zip(r.at, r.content)))
        loss, flags, samples = values(x[:, None], x)
        assert whole == loss_table.encode({"band": band, "nodes": [f"n{k}" for k in x]}, loss, flags, samples)
        want = [(f"n{a}", f"n{b}", loss[i, j], flags[i, j], samples[i, j]) for i, a in enumerate(x) for j, b in enumerate(x)]
        assert sorted((r.a, r.b, r.loss, r.flags, r.samples) for r in back if r.band == band) == sorted(want)


def test_loss_table_round_trip_at_odd_suppliers(spark, tmp_path, monkeypatch):
    """Suppliers listed twice, without a key or below zero, as in the SQL; no pair becomes a row before the table is decoded."""
    import duckdb

    from larkspan import registry
    from larkspan.operators import pairs

    monkeypatch.setattr(pairs, "every", None)
    for keys in ("0), (1), (1), (10), (2), (NULL), (70000000000", "0), (-1), (-61), (5), (5", "3", None):
        con = duckdb.connect()
        con.sql("CREATE TABLE supplier (s_suppkey BIGINT)")
        if keys:
            con.sql(f"INSERT INTO supplier VALUES ({keys})")
        con.sql(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
        got = registry.queries()["loss_table_round_trip"](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(registry.oracle_sql()["loss_table_round_trip"]).fetchall()), keys


def test_sites_and_nodes(spark, tmp_path):
    sites = write(tmp_path / "sites.csv", "# lat, lon, tx_power_dbm, surface_masl\n52.5, 13.4, 30, 40\n, 13.5, 1, 1\n52.6, 13.6, , 41\n")
    assert [(r.id, r.name, r.max_dbm) for r in feeds.read_sites(spark, sites).orderBy("id").collect()] == [(1, "site-001", 27.0), (2, "site-003", None)]
    listed = write(tmp_path / "nodes.csv", 'id,name,kind,lat,lon,height_agl_m,tx_power_dbm,last_seen_unix\n1,"Mast, Nord",Repeater,52.5,13.4,12,22,1\n2,mast nord,client,52.5,13.5,,,2\n3,???,x,52.5,13.5,bad,-40,3\n4,none,x,,,1,1,1\n')
    out = [(r.id, r.name, r.kind, r.height_m, r.height_from, r.max_dbm) for r in feeds.read_nodes(spark, listed).orderBy("id").collect()]
    assert out == [(1, "mast-nord", "repeater", 12.0, "measured", 22.0), (2, "mast-nord-2", "client", 15.0, "assumed", None), (3, "n003", "x", 15.0, "assumed", -9.0)]


def test_range_test(spark, tmp_path):
    path = write(tmp_path / "range.csv", "time,from,sender name,sender lat,sender long,rx lat,rx long,rx elevation,rx snr,distance\n10:00:00,7,Alice,52.5,13.4,52.6,13.5,40,-3.5,100\n11,,Bob,0,0,52.6,13.5,40,2,100\n12,8,Eve,52.5,13.4,,13.5,40,2,100\n13,8,Eve,52.5,13.4,95,13.5,40,2,100\n")
    out = sorted((r.tx, r.time, r.tx_lat, r.snr) for r in feeds.read_range_test(spark, path).collect())
    assert out == [("7", None, 52.5, -3.5), ("Bob", 11, None, 2.0)]
    with pytest.raises(ValueError):
        feeds.read_range_test(spark, write(tmp_path / "no.csv", "lat,lon\n1,2\n"))


def test_sensing(spark, tmp_path):
    rows = [{"kind": "session", "id": "a", "lat": 52.5, "lon": 13.4, "h_agl_m": 2, "ant_gain_dbi": 2}, {"kind": "rx", "rssi": -90.5, "src": "x"}, {"kind": "rx", "src": "y"}, {"kind": "session", "id": "b", "lat": 1, "lon": 1, "h_agl_m": 2, "ant_gain_dbi": 2}, {"kind": "rx", "rssi": -80}]
    path = write(tmp_path / "log.ndjson", "\n".join(json.dumps(r) for r in rows) + '\n# note\n\n{"kind": "rx", "rss')
    got = [(r.session, r.what) for r in feeds.read_sensing(spark, path).orderBy("line_no").collect()]
    assert got == [(1, "session"), (1, "rx"), (1, "broken"), (2, "session"), (2, "rx"), (2, "bad")]


def test_map_logs_and_grids(spark, tmp_path):
    rows = [{"public_key": "aa", "type": 2, "last_advert": "2026-01-02T03:04:60.000Z", "adv_lat": 52.5, "adv_lon": 13.4}, {"type": 9, "last_advert": "yesterday", "adv_lat": 0, "adv_lon": 0}]
    got = feeds.read_map(spark, write(tmp_path / "map.json", json.dumps(rows))).orderBy("key").collect()
    assert (got[0].key, got[0].kind, got[0].lat, got[0].stamp) == ("", "unknown", None, None)
    assert (got[1].kind, got[1].lat, got[1].stamp) == ("repeater", 52.5, 1_767_323_099)
    (tmp_path / "nodes/n1").mkdir(parents=True)
    write(tmp_path / "nodes/n1/log", "\x1b[32mSep 25 10:00:07.000 I [mail] id 0: DIRECT delivered mid=o_1_ab\x1b[0m\nSep 25 10:00:09.500 I again mid=o_1_ab\nno stamp mid=o_2\n")
    log = feeds.read_logs(spark, f"{tmp_path}/nodes/*/log", 1_790_330_400.0, 2026).collect()
    assert [(r.node, r.mid, r.delivered, r.last) for r in log] == [("n1", "o_1_ab", 7.0, " I again mid=o_1_ab")]
    people = write(tmp_path / "census.csv", "id;x_mp_100m;y_mp_100m;Einwohner\nc;4321050;3210050;12\nc;x;1;2\nc;1;2;-1\n")
    assert [tuple(r) for r in feeds.read_population(spark, people).collect()] == [(4321050.0, 3210050.0, 12.0)]
    assert feeds.read_xyz(spark, write(tmp_path / "p.xyz", "1 2 3\n 4  5 6.5\nbad\n1 2\n")).count() == 2


def test_lock_against_a_plain_fold(spark):
    rng = random.Random(3)
    frames = [(i, rng.randrange(5), (t := rng.randrange(4000)), t + rng.randrange(1, 400), float(rng.randrange(-110, -80))) for i in range(600)]
    want = {}
    for rx in range(5):
        held = None
        for f in sorted((f for f in frames if f[1] == rx), key=lambda f: (f[2], f[0])):
            if held is not None and held[3] <= f[2]:
                held = None
            if held is not None and f[4] - held[4] < 6:
                want[f[0]] = True
                continue
            if held is not None:
                want[held[0]] = True
            held = f
            want[f[0]] = False
    got = {r.eid: r.lost for r in medium.followed(spark.createDataFrame(frames, "eid long, rx long, t0 long, t1 long, level double")).collect()}
    assert got == want
    assert medium.followed(spark.createDataFrame([], "eid long, rx long, t0 long, t1 long, level double")).count() == 0
