"""Scalar functions and operators on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from larkspan.functions import radio, stats, text
from larkspan.operators import graph, intervals
from larkspan.operators.selection import node


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_radio(spark):
    lit = F.lit
    assert one(spark, radio.noise_floor(lit(125_000))) == pytest.approx(-168 + 10 * math.log10(125_000))
    assert one(spark, radio.noise_floor(lit(None).cast("int"))) == one(spark, radio.noise_floor(lit(0)))
    assert one(spark, radio.sensitivity(lit(9))) == -12.5 and one(spark, radio.sensitivity(lit(None).cast("int"))) == -20.0
    assert one(spark, radio.rejection(lit(7), lit(12))) == -9.0 and one(spark, radio.rejection(lit(5), lit(6))) == 6.0 and one(spark, radio.rejection(lit(12), lit(5))) == -25.0
    assert one(spark, radio.dbm(lit(0.0))) == float("-inf")
    assert one(spark, radio.same_carrier(lit(None).cast("long"), lit(None).cast("long"), lit(1))) is True
    assert one(spark, radio.in_band(lit(868_000_000), lit(125_000), lit(868_125_000), lit(125_000))) is False
    assert one(spark, radio.audible(lit(None).cast("double"), lit(125_000), lit(7))) is False
    assert one(spark, radio.band_of(lit(869_525_000))) == "868" and one(spark, radio.band_of(lit(2_400_000_000))) is None
    assert one(spark, radio.wrap180(lit(190.0))) == -170.0
    assert one(spark, radio.azimuth(lit(-1.0), lit(0.0))) == 270.0
    # SF7, 125 kHz, 4/5, preamble 8, 20 bytes with header and checksum
    assert one(spark, radio.time_on_air(lit(7), lit(125_000), lit(5), lit(8), lit(20), lit(False), lit(True))) == pytest.approx(0.056576)
    assert one(spark, radio.time_on_air(lit(7), lit(0), lit(5), lit(8), lit(20), lit(False), lit(True))) == 0.0
    assert one(spark, radio.short_distance(lit(52.5), lit(13.4), lit(52.5), lit(13.4))) == 0.0
    assert one(spark, radio.antenna_gain(lit(2.0), lit(75.0), lit(18.0), lit(10.0), lit(10.0))) == 2.0


def test_text(spark):
    lit = F.lit
    assert one(spark, text.slug(lit("  Größe: Mast #1 "), lit("x"))) == "gr-e-mast-1" and one(spark, text.slug(lit("???"), lit("x"))) == "x"
    for name in ("Haupt Straße", "Hauptstr.", "Haupt Str", "HAUPTSTRASSE"):
        assert one(spark, text.place_key(lit(name))) == "hauptstrasse"
    assert one(spark, text.place_key(lit("  Zoë's  Café "))) == "zoë s cafe"
    assert [one(spark, text.match_score(lit(h), lit("berlin"))) for h in ("berlin", "berlin mitte", "neu berlin", "xberlin", "paris")] == [1000, 694, 496, 249, None]
    assert tuple(one(spark, text.preset(lit("SF8/BW62/CR8")))) == (8, 62.5, 8) and tuple(one(spark, text.preset(lit("MEDIUM_FAST")))) == (9, 250.0, 5)
    assert one(spark, text.preset(lit("SF13/BW62/CR8"))) is None and one(spark, text.preset(lit("nope"))) is None
    assert one(spark, text.rfc3339_seconds(lit("1970-01-01T00:01:00.000Z"))) == 60 and one(spark, text.rfc3339_seconds(lit("1970-02-30T00:00:00.000Z"))) is None
    assert one(spark, text.tile_name(lit(-3), lit(7))) == "S03E007" and one(spark, text.utm_zone(lit(13.4))) == 33
    assert one(spark, text.small_uint(lit(7.5))) is None and one(spark, text.small_uint(lit(255.0))) == 255
    assert one(spark, text.level_height(lit("12 m"))) == 12.0 and one(spark, text.level_height(lit("10'6\""))) == pytest.approx(3.2004)
    h = 0
    for c in "status":
        h = (h * 31 + ord(c)) % 256
    assert one(spark, text.query_id(lit("status"))) == 0x20 + h % 160


def test_quantiles(spark):
    values = [5, 1, 9, 9, 2, 2, 2]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, None)], "k int, v int")
    got = {r.k: r for r in df.groupBy("k").agg(*stats.five_numbers(F.col("v"))).collect()}
    assert tuple(got[1])[1:] == (1, 2, 2, 9, 9) and got[2].middle is None
    assert tuple(stats.ranked_quantiles(df, ["k"], "v", {"q": 0.5, "top": 1.0}).first()) == (1, 2, 9)


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 5, 8), (1, 20, 30), (2, 0, 1)], "k int, t0 long, t1 long")
    assert {r.k: r.busy for r in intervals.union_length(df, ["k"]).collect()} == {1: 20, 2: 1}
    assert {r.k: (r.worst, r.worst_from) for r in intervals.worst_window(df, ["k"], 20).collect()} == {1: (13, 0), 2: (1, 0)}
    assert {r.k: r.pause for r in intervals.shortest_pause(df, ["k"]).collect()} == {1: -5, 2: None}
    assert intervals.worst_window(df.limit(0), ["k"], 20).count() == 0


def test_graph(spark):
    links = spark.createDataFrame([(a, b) for a, b in [(1, 2), (2, 3), (3, 4), (6, 7)] for a, b in ((a, b), (b, a))], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "node long")
    assert {r.node: r.comp for r in graph.components(links, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    src = spark.createDataFrame([(1,)], "src long")
    assert {r.node: r.d for r in graph.hops(links, src).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node: r.d for r in graph.hops(links, src, spark.createDataFrame([(2,)], "node long")).collect()} == {1: 0, 2: 1, 3: 2}
    one_way = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a long, b long")
    assert graph.both_ways(one_way).count() == 2


def _random_links(rng, n: int, k: int) -> set:
    some = [(rng.randrange(n), rng.randrange(n)) for _ in range(k)]
    return {(a, b) for a, b in some + [(b, a) for a, b in some] if a != b}


@pytest.mark.parametrize("most", [None, 3])
def test_hops_against_breadth_first(spark, most):
    import random

    rng = random.Random(2)
    links = _random_links(rng, 300, 330) | {(1000 + i, 1001 + i) for i in range(40)} | {(1001 + i, 1000 + i) for i in range(40)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    passes = {x for x in range(1100) if x % 3}
    sources = [*range(150), 1000, 5000, 7, None]  # 5000 has no links, 7 is there twice

    def walk(src, via):
        got, front, d = {src: 0}, {src}, 0
        while front and d != most:
            d += 1
            front = {y for x in front if via is None or x == src or x in via for y in near.get(x, ())} - got.keys()
            got |= dict.fromkeys(front, d)
        return {(src, x, k) for x, k in got.items()}

    table, src = spark.createDataFrame(sorted(links), "a long, b long"), spark.createDataFrame([(x,) for x in sources], "src long")
    for via in (None, passes):
        got = [(r.src, r.node, r.d) for r in graph.hops(table, src, None if via is None else spark.createDataFrame([(x,) for x in via], "node long"), most).collect()]
        want = set().union(*[walk(x, via) for x in sources])
        assert len(got) == len(want) and set(got) == want
    want = set().union(*[walk(x, None) for x in sources])
    assert tuple(graph.diameter(table, src, 154, most).first()) == (max(k for *_, k in want), 154 * 154 - len(want))


def test_diameter_of_more_pairs_than_an_int_counts(spark):
    links = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    for nodes in (46_341, 60_000):  # whose squares are beyond 2^31
        assert tuple(graph.diameter(links, spark.createDataFrame([(1,), (2,), (3,)], "src long"), nodes).first()) == (1, nodes * nodes - 5)


def test_hop_queries_at_odd_suppliers(spark, tmp_path):
    """Stations that are no customers, and ways of more than 30 hops, as in the SQL."""
    import duckdb

    from larkspan import registry

    con = duckdb.connect()
    con.sql("CREATE TABLE supplier AS SELECT CAST(pow(3, i) AS BIGINT) AS s_suppkey FROM range(36) t(i) UNION ALL SELECT 7 * i + 2 FROM range(10) t(i)")
    con.sql("CREATE VIEW customer AS SELECT * FROM '/root/testdata/sf0.001/customer.parquet' WHERE c_custkey % 9 <> 0")
    for name in ("supplier", "customer"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    for name in ("hop_counts", "hop_counts_forwarding", "delivery_hops", "network_diameter"):
        cols = sorted(registry.queries()[name](spark, str(tmp_path)).columns)
        got = registry.queries()[name](spark, str(tmp_path)).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()), name


def test_components_of_chains_and_random_links(spark):
    import random

    rng = random.Random(1)
    for n, links in ((60, [(rng.randrange(64), rng.randrange(64)) for _ in range(40)]), (200, [(i, i + 1) for i in range(199)]), (9, [])):
        perm = rng.sample(range(n), n) + list(range(n, 64))
        links = [(perm[a], perm[b]) for a, b in links]
        up = list(range(n))
        find = lambda x: x if up[x] == x else find(up[x])  # noqa: B023, E731
        for a, b in links:
            if a < n and b < n:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        both = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long")
        got = {r.node: r.comp for r in graph.components(both, spark.createDataFrame([(i,) for i in range(n)], "node long")).collect()}
        assert got == {i: find(i) for i in range(n)}


def test_greedy_coverage_is_the_plain_one(spark):
    import random

    rng = random.Random(8)
    covers = {c: {rng.randrange(60) for _ in range(rng.randint(1, 20))} for c in range(15)}
    weights = {i: rng.randint(1, 9) for i in range(60)}
    for k in (1, 2):
        n, left, want = dict.fromkeys(range(60), 0), dict(covers), []
        for step in range(5):
            gains = {c: sum(weights[i] for i in s if n[i] < k) for c, s in left.items()}
            best = min(gains, key=lambda c: (-gains[c], c))
            want.append((step, best, gains[best]))
            for i in left.pop(best):
                n[i] += 1
        a = spark.createDataFrame([(c, i) for c, s in covers.items() for i in s], "cand long, item long")
        got = graph.greedy_coverage(a, spark.createDataFrame(list(weights.items()), "item long, w long"), 5, k)
        assert [tuple(r) for r in got.orderBy("step").collect()] == want


def test_selection(spark):
    df = spark.createDataFrame([(1, "a", ["x"], None), (2, "b", ["y", "x"], "r"), (3, "c", None, "s")], "id int, name string, tags array<string>, role string")
    assert node(tags="x").pick(df) == ["a", "b"]
    assert (~node(role="r")).pick(df) == ["a", "c"]
    assert (node(tags=["y"]) ^ node(id=[2, 3])).pick(df) == ["c"]
    assert (node(tags="x") - node(role="r")).pick(df) == ["a"] and (node(id=1) & node(id=2)).pick(df) == []
    with pytest.raises(ValueError):
        node(colour="red").pick(df)


def test_projection(spark):
    from larkspan.functions import geo

    points = [(52.5163, 13.3777), (0.0, 15.0), (-33.9, 17.2), (69.6, 12.01), (52.0, 18.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    x, y = geo.utm(F.col("lat"), F.col("lon"), 33)
    both = df.withColumn("x", x).withColumn("y", y)
    lat, lon = geo.degrees_of_utm(F.col("x"), F.col("y"), 33)
    out = both.select("lat", "lon", "x", "y", lat.alias("la"), lon.alias("lo")).collect()
    for r in out:
        assert abs(r.la - r.lat) < 1e-10 and abs(r.lo - r.lon) < 1e-10
    gate = next(r for r in out if r.lat == 52.5163)
    assert abs(gate.x - 389_912) < 30 and abs(gate.y - 5_819_700) < 60
    origin = next(r for r in out if r.lat == 0.0)
    assert abs(origin.x - 500_000) < 1e-6 and abs(origin.y) < 1e-6


def test_polygons(spark):
    from larkspan.functions import geo

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(square, 1.0, 1.0), (square, 5.0, 1.0), ([(1.0, 2.0), (3.0, 4.0)], 1.0, 1.0)], "ring array<struct<x:double,y:double>>, x double, y double")
    r = df.select(geo.ring_area(F.col("ring")).alias("a"), geo.ring_centroid(F.col("ring")).alias("c"), geo.in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("i")).collect()
    assert [x.a for x in r] == [16.0, 16.0, 0.0] and tuple(r[0].c) == (2.0, 2.0) and tuple(r[2].c) == (1.0, 2.0)
    assert [x.i for x in r[:2]] == [True, False]


def test_paths(spark):
    from larkspan.functions import paths

    flat = spark.createDataFrame([([0.0, 50.0, 100.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), ([0.0, 50.0, 100.0], [0.0, 0.0, 0.0], [0.0, 30.0, 0.0]), ([0.0, 100.0], [0.0, 0.0], [0.0, 0.0])], "d array<double>, h array<double>, g array<double>")
    out = [r[0] for r in flat.select(paths.near_field_loss(F.lit(869.525), F.col("d"), F.col("h"), F.col("g"), F.lit(10.0), F.lit(10.0))).collect()]
    free = 32.44 + 20 * math.log10(869.525) + 20 * math.log10(0.1)
    assert out[0] == pytest.approx(free) and out[1] > free + 15 and out[2] is None
    assert one(spark, paths.knife_edge(F.lit(0.0))) == pytest.approx(6.9 + 20 * math.log10(math.sqrt(1.01) - 0.1))
    assert one(spark, paths.height_gain(F.lit(0.868), F.lit(12.0), F.lit(10.0), F.lit(27.0), F.lit(True))) == 0.0
    assert one(spark, paths.height_gain(F.lit(0.868), F.lit(1.5), F.lit(15.0), F.lit(27.0), F.lit(True))) > 5
    assert tuple(one(spark, paths.estimated_height(F.lit(None).cast("double"), F.lit(60.0), F.lit(3.0), F.lit(5)))) == (30.0, "building")


def test_swaps_never_lose_and_reach_the_best(spark):
    import itertools
    import random

    rng = random.Random(6)
    covers = {c: {rng.randrange(25) for _ in range(rng.randint(2, 8))} for c in range(8)}
    weights = {i: rng.randint(1, 9) for i in range(25)}
    value = lambda s: sum(weights[i] for i in set().union(*(covers[c] for c in s)))
    a = spark.createDataFrame([(c, i) for c, s in covers.items() for i in s], "cand long, item long")
    chosen, total = graph.improve_by_swaps(a, spark.createDataFrame(list(weights.items()), "item long, w long"), [0, 1, 2])
    assert total == value(chosen) >= value([0, 1, 2]) and len(set(chosen)) == 3
    for out, into in itertools.product(chosen, set(range(8)) - set(chosen)):
        assert value([c for c in chosen if c != out] + [into]) <= total


def test_frame_kinds(spark):
    from larkspan.functions import frames

    def packet(kind, context, address=b"\x11" * 16, data=b"", two=False, flags=0):
        return bytes([0, kind | flags | (0x40 if two else 0), 3]) + (b"\x22" * 16 if two else b"") + address + bytes([context]) + data

    announce = b"\x33" * 64 + frames.name_hash("lxmf.delivery") + b"\x44" * 20
    cases = [
        (b"", 0, "empty"), (None, 0, "empty"), (b"\xc2\x01\x02\x03", 0, "SUPE HAIL"), (b"\x04\x10\x00\x00", 0, "power request"), (packet(0, 0), 2, None),
        (b"\x00\x01", 0, "other"), (packet(0, 0, flags=0x80), 0, "other"), (packet(1, 0, data=announce), 0, "announce lxmf.delivery"), (packet(1, 0, data=announce, two=True), 1, "announce lxmf.delivery"),
        (packet(1, 0, data=b"x" * 80), 0, "announce other"), (packet(1, 0x0B, data=announce), 0, "path response"), (packet(2, 0), 0, "link request"), (packet(3, 0xFF), 0, "link proof"), (packet(3, 1), 0, "proof"),
        (packet(0, 0, frames.plain_address("rnstransport.path.request")), 0, "path request"), (packet(0, 0xFE), 0, "link control"), (packet(0, 5), 0, "resource"), (packet(0, 0x0E), 0, "data"),
    ]
    df = spark.createDataFrame([(i, p, part) for i, (p, part, _) in enumerate(cases)], "i int, p binary, part int")
    out = df.select("i", frames.kind_of(F.col("p"), F.col("part")).alias("k"), frames.announced(F.col("p"), F.col("part")).alias("a")).orderBy("i").collect()
    assert [r.k for r in out] == [k for _, _, k in cases]
    assert tuple(out[8].a) == ("11" * 16, 3) and out[2].a is None and out[15].a is None
    assert [one(spark, frames.calling_class(F.lit(k))) for k in ("announce other", "SUPE HAIL", "SUPE GOT", "data")] == ["announces_and_path", "hails", "supe_other", "unicast"]


def test_pairs_at_shared_places(spark):
    """Points that share a place, more than a row holds, and repeated ones: pairs by brute force, and no side of every() broadcast."""
    from larkspan.operators import pairs

    points = [(i, i % 7 * 10, i % 3 * 10) for i in range(60)] + [(3, 30, 0)]
    df = spark.createDataFrame(points, "i long, x long, y long")
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    want = sorted((p[0], q[0], d2(p, q)) for p in points for q in points if p[0] < q[0] and d2(p, q) <= 225)
    before, pairs.AT_ONCE = pairs.AT_ONCE, 2
    try:
        assert sorted(map(tuple, pairs.within(df, "i", "x", "y", 15).collect())) == want
    finally:
        pairs.AT_ONCE = before
    left, right = spark.range(1000).toDF("a"), spark.range(700).toDF("b")
    both = pairs.every(left, right)
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.distinct().count() == both.count() == 700_000
