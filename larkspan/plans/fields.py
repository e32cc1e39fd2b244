"""Queries of deliveries, sensing logs, settings, names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import geo, radio, text
from larkspan.operators import delivery, feeds, graph, names
from larkspan.plans import bridge, ground
from larkspan.plans.bridge import FRAMES, NODES
from larkspan.plans.storage import cut

SQL: dict[str, str] = {}


def _sends(spark, sf_dir):
    """Messages between stations: a frame is one; some have no way, no mid, or no log."""
    e, n = F.col("eid"), bridge.stations(spark, sf_dir).count()
    f = bridge.frames(spark, sf_dir).select("eid", "t0", (F.col("sid") % n).alias("s"))
    return f.select(
        F.concat(F.lit("m"), e.cast("string")).alias("marker"), F.col("s").alias("src"), ((F.col("s") + e % 5 + 1) % n).alias("dst"), F.get(F.array(F.lit("short"), F.lit("two"), F.lit("big")), (e % 3).cast("int")).alias("cls"),
        F.when(e % 10 != 9, e % 10).cast("int").alias("hops"), F.when(e % 13 != 0, F.concat(F.lit("o_"), e.cast("string"), F.lit("_x"))).alias("mid"), F.col("t0").alias("t_sent"),
    )


def _logs(spark, sf_dir):
    """Two lines of each message that has a mid, but for some; the second of most says that it was delivered."""
    s = _sends(spark, sf_dir).filter("mid IS NOT NULL").withColumn("e", F.substring_index(F.substring("marker", 2, 30), "_", 1).cast("long")).filter("e % 17 <> 0")
    last = F.when(F.col("e") % 4 != 0, F.concat(F.lit("DIRECT delivered mid="), "mid")).otherwise(F.concat(F.lit("retry "), (F.col("e") % 7).cast("string"), F.lit(" of "), "mid", F.lit(" by lxmf.id3.7f9 to deadbeef01")))
    first = s.select("src", "mid", (F.col("t_sent") + 1000).alias("t"), F.concat(F.lit("queued mid="), "mid").alias("line"), F.lit(1).alias("n"))
    return first.unionByName(s.select("src", "mid", (F.col("t_sent") + (F.col("e") % 50 + 1) * 100_000).alias("t"), last.alias("line"), F.lit(2).alias("n")))


_D = f"""{FRAMES}, {ground._HOPS}, c AS (SELECT count(*) AS c FROM n), s AS (SELECT eid AS e, sid % c AS src, (sid % c + eid % 5 + 1) % c AS dst, ['short', 'two', 'big'][eid % 3 + 1] AS cls, CASE WHEN eid % 10 <> 9 THEN eid % 10 END AS hops, eid % 13 <> 0 AS has, t0 FROM frames, c),
r(src, node, d) AS (SELECT id, id, 0 FROM n UNION SELECT src, l.b, d + 1 FROM r JOIN l ON l.a = r.node WHERE d < 30 AND (d = 0 OR r.node % 3 = 0)), g AS (SELECT src, node, CAST(min(d) AS BIGINT) AS d FROM r WHERE d > 0 GROUP BY src, node),
m AS (SELECT s.*, has AND e % 17 <> 0 AND e % 4 <> 0 AS ok, CASE WHEN hops IS NULL THEN 'no path' WHEN hops <= 6 THEN CAST(hops AS VARCHAR) ELSE '7+' END AS route, CASE WHEN d IS NULL THEN 'none' WHEN d <= 6 THEN CAST(d AS VARCHAR) ELSE '7+' END AS radio, (e % 50 + 1) * 100000 AS latency FROM s LEFT JOIN g ON g.src = s.src AND g.node = s.dst)"""


def _delivered(spark, sf_dir):
    sends = cut(_sends(spark, sf_dir))
    via = bridge.nodes(spark, sf_dir).filter("role = 'transport'").select(F.col("id").alias("node"))
    ways = graph.relayed_hops(ground._hop_links(spark, sf_dir), sends.select("src", "dst").distinct(), via)
    return delivery.delivered(sends, delivery.logged(_logs(spark, sf_dir)), ways)


def delivery_shares(spark, sf_dir):
    """Messages delivered of those sent: in all, by hops on the route and on the radio, and by class."""
    return delivery.shares(_delivered(spark, sf_dir))


SQL["delivery_shares"] = f"""WITH RECURSIVE {_D}, u AS (SELECT 'all' AS split, 'all' AS name, ok FROM m UNION ALL SELECT 'route', route, ok FROM m UNION ALL SELECT 'radio', radio, ok FROM m UNION ALL SELECT 'class', cls, ok FROM m),
t AS (SELECT split, name, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS ok, count(*) AS sent FROM u GROUP BY split, name)
SELECT split, name, CAST(CASE WHEN name IN ('no path', 'none') THEN 8 WHEN name = '7+' THEN 7 ELSE coalesce(TRY_CAST(name AS INT), 0) END AS BIGINT) AS place, ok, sent, printf('%d/%d (%.1f%%)', ok, sent, 100.0::DOUBLE * ok / sent) AS text FROM t"""


def delivery_delays(spark, sf_dir):
    """How long delivered messages took, by class."""
    return delivery.delays(_delivered(spark, sf_dir), "cls")


SQL["delivery_delays"] = f"""WITH RECURSIVE {_D}, q AS (SELECT cls, list_sort(list(latency)) AS p, count(*) AS n, round(sum(latency) / count(*), 6) AS mean FROM m WHERE ok GROUP BY cls)
SELECT cls, n, mean, p[1] AS least, p[CAST(floor(0.25 * (n - 1) + 0.5) AS INT) + 1] AS p25, p[CAST(floor(0.5 * (n - 1) + 0.5) AS INT) + 1] AS median, p[CAST(floor(0.75 * (n - 1) + 0.5) AS INT) + 1] AS p75, p[CAST(floor(0.9 * (n - 1) + 0.5) AS INT) + 1] AS p90, p[n] AS most FROM q"""


def undelivered_words(spark, sf_dir):
    """The commonest last words about messages that failed, without ids and numbers."""
    return delivery.last_words(_delivered(spark, sf_dir))


SQL["undelivered_words"] = f"""WITH RECURSIVE {_D}, w AS (SELECT CASE WHEN NOT has THEN 'no mid' WHEN e % 17 = 0 THEN 'no log line' ELSE 'retry N of … by … to …' END AS word FROM m WHERE NOT ok) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25"""


def sensing_yield(spark, sf_dir):
    """Receptions as sensing records: how many pass each gate."""
    e = F.col("eid")
    r = bridge.receptions(spark, sf_dir).select(
        F.when(e % 31 == 0, float("nan")).otherwise(F.col("level").cast("double")).alias("rssi"), F.when(e % 7 == 0, "").otherwise(F.col("tx").cast("string")).alias("src"), F.when(e % 5 != 0, F.lit(52.5)).alias("lat"), F.lit(13.4).alias("lon"),
        F.when(e % 3 != 0, e % 2).alias("hops_travelled"), F.when(e % 11 == 0, F.lit(2)).alias("hops_remaining"),
    )
    return feeds.sensed(r).groupBy("gate").agg(F.count(F.lit(1)).alias("records"))


SQL["sensing_yield"] = f"""WITH {FRAMES}, {bridge.RECEPTIONS} SELECT CASE WHEN eid % 31 = 0 THEN 'bad_rssi' WHEN eid % 7 = 0 THEN 'no_sender' WHEN eid % 5 = 0 THEN 'no_tx_position' WHEN eid % 11 = 0 THEN 'relayed' WHEN eid % 3 = 0 THEN 'hops_unknown' WHEN eid % 2 = 1 THEN 'relayed' ELSE 'usable' END AS gate, count(*) AS records FROM receptions GROUP BY 1"""


def lines_since_start(spark, sf_dir):
    """Each station's lines by time of day, counted from its first one over midnight, up to twenty hours."""
    day = 86_400_000_000
    f = bridge.frames(spark, sf_dir).select("sid", "eid", (F.col("t0") % day / 1_000_000.0).alias("at"))
    first = f.groupBy("sid").agg(F.min_by("at", "eid").alias("start"))
    out = feeds.since_start(f.join(first, "sid"), ["sid"], "eid", "at", F.col("start"), 72_000.0)
    return out.groupBy("sid").agg(F.count(F.lit(1)).alias("lines"), F.round(F.max("at"), 6).alias("last_s"))


SQL["lines_since_start"] = f"""WITH {FRAMES}, a AS (SELECT sid, eid, t0 % 86400000000 / 1000000.0 AS s FROM frames), b AS (SELECT *, s - first_value(s) OVER (PARTITION BY sid ORDER BY eid) AS p FROM a), c AS (SELECT sid, eid, CASE WHEN p < 0 THEN p + 86400 ELSE p END AS p FROM b),
d AS (SELECT *, max(CASE WHEN p > 72000 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY eid ROWS UNBOUNDED PRECEDING) AS late FROM c) SELECT sid, count(*) AS lines, round(max(p), 6) AS last_s FROM d WHERE late = 0 GROUP BY sid"""


def decodable(spark, sf_dir):
    """Receptions whose receiver is set to the frame's channel, bandwidth, spreading factor and sync word."""
    f = bridge.frames(spark, sf_dir).select("eid", "freq", "bw", "sf", F.when(F.col("eid") % 3 != 0, F.lit(18)).alias("sync"))
    r = bridge.receptions(spark, sf_dir).select("eid", "rx").join(f, "eid")
    state = F.struct((F.col("freq") + F.col("rx") % 3 * 20_000).alias("freq"), F.col("bw"), (F.col("rx") % 2 + F.col("sf") - F.col("eid") % 2).alias("sf"), F.when(F.col("rx") % 5 != 0, F.lit(18)).alias("sync"))
    return r.filter(radio.modem_matches(state, F.struct("freq", "bw", "sf", "sync"))).groupBy("rx").agg(F.count(F.lit(1)).alias("frames"))


SQL["decodable"] = f"WITH {FRAMES}, {bridge.RECEPTIONS} SELECT rx, count(*) AS frames FROM receptions JOIN frames USING (eid) WHERE rx % 3 * 20000 <= 31250 AND rx % 2 = eid % 2 AND (eid % 3 <> 0) = (rx % 5 <> 0) GROUP BY rx"


def frame_timelines(spark, sf_dir):
    """Frames as they go on the air: starts not before now, and lengths, preambles and headers in bounds."""
    e, t = F.col("eid"), F.col("t0")
    long_ = lambda c: c.cast("long")
    f = bridge.frames(spark, sf_dir).select("eid", "t0", radio.frame_times(t, F.when(e % 9 != 0, F.col("t1")), long_(t + e % 4 * 50_000_000 - 10), long_(t + e % 6 * 20_000_000), long_(t + (e % 5 - 2) * 1000)).alias("x"))
    return f.select("eid", (F.col("x.start") - t).alias("late"), (F.col("x.end") - F.col("x.start")).alias("span"), (F.col("x.pre") - F.col("x.start")).alias("pre"), (F.col("x.hdr") - F.col("x.start")).alias("hdr"))


SQL["frame_timelines"] = f"""WITH {FRAMES}, a AS (SELECT eid, greatest(0, (eid % 5 - 2) * 1000) AS late, CASE WHEN eid % 9 = 0 THEN 0 ELSE greatest(0, least(span, 60000000)) END AS span FROM frames), b AS (SELECT *, greatest(0, least(eid % 4 * 50000000 - 10, span)) AS pre FROM a)
SELECT eid, late, span, pre, greatest(pre, least(eid % 6 * 20000000, span)) AS hdr FROM b"""


def power_limits(spark, sf_dir):
    """Stated powers of nodes: what they can send at most, and whether that needs a front end or is out of bounds."""
    own = F.when(F.col("id") % 4 != 0, (F.col("id") % 41 - 12).cast("double"))
    n = bridge.nodes(spark, sf_dir).select(radio.station_power(own).alias("p"))
    return n.groupBy(F.col("p.front_end").alias("front_end"), F.col("p.ok").alias("ok")).agg(F.count(F.lit(1)).alias("nodes"), F.max("p.max_dbm").alias("most"))


SQL["power_limits"] = f"WITH {NODES}, p AS (SELECT CASE WHEN id % 4 <> 0 THEN CAST(id % 41 - 12 AS DOUBLE) END AS own FROM nodes), q AS (SELECT coalesce(own, 22.0) AS m, coalesce(own BETWEEN -9 AND 27, true) AS ok FROM p) SELECT m > 22 AS front_end, ok, count(*) AS nodes, CAST(max(m) AS DOUBLE) AS most FROM q GROUP BY ALL"


def link_answers(spark, sf_dir):
    """Link answers as cells of a loss table: by flags, how many there are, and the sum of the losses that are known."""
    e = F.col("eid")
    f = bridge.frames(spark, sf_dir).select(
        e, "freq", F.when(e % 5 == 0, 422).alias("status"), F.get(F.array(F.lit("path leaves the pack"), F.lit("beyond the window cap"), F.lit("ends within 20 m"), F.lit("path too short"), F.lit("out of order")), (F.floor(e / 5) % 5).cast("int")).alias("text"),
        (e % 60 + 80).cast("double").alias("loss"), F.when(e % 3 == 0, "p1812").when(e % 3 == 1, "near").alias("model"), F.when(e % 2 == 0, "clear").otherwise("grazing").alias("verdict"), ((e % 19) + 1.0).alias("m"),
    )
    c = radio.reply_cell(F.col("status"), F.col("text"), F.col("loss"), F.col("model"), F.col("verdict"), F.col("freq"), F.col("m"))
    return f.select(c.alias("c")).groupBy(F.coalesce("c.flags", F.lit(-1)).alias("flags")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.when(F.col("c.loss") < radio.NEVER, F.col("c.loss"))), 4).alias("loss"))


SQL["link_answers"] = f"""WITH {FRAMES}, c AS (SELECT CASE WHEN eid % 5 <> 0 THEN CASE WHEN eid % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN eid % 2 = 0 THEN 8 ELSE 0 END ELSE [2, 4, 1, 1, -1][(eid // 5) % 5 + 1] END AS flags,
CASE WHEN eid % 5 <> 0 THEN CAST(eid % 60 + 80 AS DOUBLE) WHEN (eid // 5) % 5 IN (2, 3) THEN 20.0 * log10(4.0 * pi() * freq / 299792458.0) + 20.0 * log10((eid % 19) + 1.0::DOUBLE) END AS loss FROM frames) SELECT CAST(flags AS INTEGER) AS flags, count(*) AS pairs, round(sum(loss), 4) AS loss FROM c GROUP BY flags"""


def clock_texts(spark, sf_dir):
    """Instants of a run as a clock shows them, and the share of the frames sent by then that were long."""
    f = bridge.frames(spark, sf_dir).select("eid", (F.col("eid") * 7_919_000_001).alias("us"), (F.col("eid") % 37).alias("a"), (F.col("eid") % 41).alias("b"))
    return f.select("eid", text.clock(F.col("us")).alias("clock"), text.share(F.least("a", "b"), F.col("b")).alias("share"))


SQL["clock_texts"] = f"""WITH {FRAMES}, s AS (SELECT eid, eid * 7919000001 // 1000000 AS s, eid % 37 AS a, eid % 41 AS b FROM frames)
SELECT eid, CASE WHEN s >= 86400 THEN printf('%dd + %02d:%02d', s // 86400, s % 86400 // 3600, s % 3600 // 60) ELSE printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS clock, CASE WHEN b > 0 THEN printf('%d/%d (%.1f%%)', least(a, b), b, 100.0::DOUBLE * least(a, b) / b) ELSE '0/0' END AS share FROM s"""


def labelled_frames(spark, sf_dir):
    """Frames whose kind holds one of some words."""
    f = bridge.frames(spark, sf_dir)
    return f.filter(text.named_like(F.upper("kind"), " CLI, err,,")).groupBy("kind").agg(F.count(F.lit(1)).alias("frames"))


SQL["labelled_frames"] = f"WITH {FRAMES} SELECT kind, count(*) AS frames FROM frames WHERE contains(kind, 'cli') OR contains(kind, 'err') GROUP BY kind"


def given_names(spark, sf_dir):
    """Unique names from a few bases, in the order of the nodes."""
    n = bridge.nodes(spark, sf_dir).select("id", F.concat(F.lit("station-with-a-rather-long-name-"), (F.col("id") % 9).cast("string")).alias("long"), F.col("id").alias("k"))
    n = n.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("site-"), (F.col("id") % 50).cast("string"))).otherwise(F.col("long")).alias("base"))
    return names.unique_names(n, "base", "id").select("id", "name")


SQL["given_names"] = f"""WITH {NODES}, b AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'site-' || (id % 50) ELSE 'station-with-a-rather-long-name' END AS base FROM nodes), k AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM b)
SELECT id, CASE WHEN k = 1 THEN base ELSE rtrim(substr(base, 1, 32 - length('-' || k)), '-') || '-' || k END AS name FROM k"""


def given_numbers(spark, sf_dir):
    """The lowest free numbers for new nodes, where others are taken."""
    taken = bridge.read(spark, sf_dir, "part").select((F.col("p_partkey") * 3 % 1000 + 1).alias("id"))
    return names.free_numbers(bridge.nodes(spark, sf_dir).select(F.col("id").alias("node")), "node", taken)


SQL["given_numbers"] = f"""WITH {NODES}, t AS (SELECT DISTINCT p_partkey * 3 % 1000 + 1 AS id FROM part), f AS (SELECT i AS id, row_number() OVER (ORDER BY i) AS k FROM range(1, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM t) + 1) r(i) WHERE i NOT IN (SELECT id FROM t)), n AS (SELECT id AS node, row_number() OVER (ORDER BY id) AS k FROM nodes) SELECT node, f.id FROM n JOIN f USING (k)"""


def key_bytes(spark, sf_dir):
    """Keys written in hexadecimal: how many are whole, and how many survive the way to bytes and back."""
    k = F.when(F.col("id") % 5 == 0, F.lit("zz")).otherwise(F.sha2("name", 256))
    n = bridge.nodes(spark, sf_dir).select(k.alias("k")).withColumn("b", text.hex_bytes(F.upper("k"), 32))
    return n.agg(F.count("b").alias("whole"), F.count_if(F.lower(F.hex("b")) == F.col("k")).alias("same"), F.count(F.lit(1)).alias("keys"))


SQL["key_bytes"] = f"WITH {NODES} SELECT count(*) FILTER (id % 5 <> 0) AS whole, count(*) FILTER (id % 5 <> 0) AS same, count(*) AS keys FROM nodes"


def synthetic_positions(spark, sf_dir):
    """Nodes on synthetic ground: metres, and degrees again."""
    n = bridge.nodes(spark, sf_dir).select("id", geo.synthetic_xy(F.col("y") / 10000.0, F.col("x") / 10000.0).alias("p"))
    back = geo.synthetic_latlon(F.col("p.x"), F.col("p.y"))
    return n.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round(back["lat"], 6).alias("lat"), F.round(back["lon"], 6).alias("lon"))


SQL["synthetic_positions"] = f"WITH {NODES} SELECT id, round(x / 10000.0 * 111120.0, 3) AS x, round(y / 10000.0 * 111120.0, 3) AS y, round(y / 10000.0, 6) AS lat, round(x / 10000.0, 6) AS lon FROM nodes"


def tiles_met(spark, sf_dir):
    """Boxes of nodes against one region: how many meet it if boxes are closed, and if they are half-open."""
    b = bridge.nodes(spark, sf_dir).select(F.struct(F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + 500).alias("east"), (F.col("y") + 500).alias("north")).alias("b"))
    region = F.struct(F.lit(3919).alias("west"), F.lit(4729).alias("south"), F.lit(12_000).alias("east"), F.lit(15_000).alias("north"))
    return b.agg(F.count_if(geo.boxes_meet(F.col("b"), region, True)).alias("closed"), F.count_if(geo.boxes_meet(F.col("b"), region, False)).alias("half_open"))


SQL["tiles_met"] = f"WITH {NODES} SELECT count(*) FILTER (x <= 12000 AND x + 500 >= 3919 AND y <= 15000 AND y + 500 >= 4729) AS closed, count(*) FILTER (x < 12000 AND x + 500 > 3919 AND y < 15000 AND y + 500 > 4729) AS half_open FROM nodes"


def building_heights(spark, sf_dir):
    """Buildings by where their height comes from."""
    p = bridge.read(spark, sf_dir, "part").select(F.get(F.array(F.lit("levels"), F.lit("tag"), F.lit("none")), (F.col("p_size") % 3).cast("int")).alias("source"), F.when(F.col("p_size") % 3 != 2, F.col("p_size") * 3).alias("height"))
    return feeds.height_census(p, "source", "height")


SQL["building_heights"] = "SELECT ['levels', 'tag', 'none'][p_size % 3 + 1] AS source, count(*) AS buildings, count(*) FILTER (p_size % 3 <> 2) AS with_height, CAST(sum(CASE WHEN p_size % 3 <> 2 THEN p_size * 3 END) AS BIGINT) AS height_sum FROM part GROUP BY 1"


def command_lines(spark, sf_dir):
    """Command lines with a node's name, number and another's address filled in."""
    n = bridge.nodes(spark, sf_dir)
    to = F.create_map(F.lit("hub"), F.lit("127.0.0.9"), F.lit("peer"), F.concat(F.lit("127.0.1."), (F.col("id") % 250).cast("string")))
    return n.select("id", text.expanded(F.lit("run {name} --id {id} --to {addr:peer},{addr:hub} {addr:none}"), F.lower("name"), F.col("id"), to).alias("line"))


SQL["command_lines"] = f"WITH {NODES} SELECT id, 'run ' || lower(name) || ' --id ' || id || ' --to 127.0.1.' || (id % 250) || ',127.0.0.9 {{addr:none}}' AS line FROM nodes"

QUERIES = {name: globals()[name] for name in SQL}
