"""Queries over node tables and text: feed filters, deduplication, selections, merges, names, prefixes, presets, search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.operators import feeds, pairs
from larkspan.operators.selection import node
from larkspan.plans import bridge
from larkspan.plans.bridge import NODES

NOW = 1_717_000_000
SQL: dict[str, str] = {}


def _feed(spark, sf_dir):
    """The node view as a public feed: kind, position, stamp, key; some of them missing."""
    n = bridge.nodes(spark, sf_dir)
    k = F.col("id")
    return n.select(k, F.col("role").alias("kind"), F.when(k % 11 != 0, F.col("y") / 10000.0 + 51.5).alias("lat"), F.when(k % 11 != 0, F.col("x") / 10000.0 + 12.5).alias("lon"), F.when(k % 13 != 0, F.col("heard") + F.when(k % 17 == 0, 40_000_000).otherwise(0)).alias("stamp"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("k"), (k % 400).cast("string"))).alias("key"))


_FEED = f"{NODES}, feed AS (SELECT id, role AS kind, CASE WHEN id % 11 <> 0 THEN y / 10000.0 + 51.5 END AS lat, CASE WHEN id % 11 <> 0 THEN x / 10000.0 + 12.5 END AS lon, CASE WHEN id % 13 <> 0 THEN heard + CASE WHEN id % 17 = 0 THEN 40000000 ELSE 0 END END AS stamp, CASE WHEN id % 19 = 0 THEN '' ELSE 'k' || (id % 400) END AS key FROM nodes)"
_BUCKET = f"CASE WHEN kind NOT IN ('transport', 'router') THEN 'wrong kind' WHEN lat IS NULL OR lon IS NULL THEN 'no position' WHEN NOT (lat BETWEEN 51.7 AND 53.2 AND lon BETWEEN 12.6 AND 14.2) THEN 'outside' WHEN stamp - {NOW} > 7 * 86400 THEN 'future' WHEN {NOW} - stamp > 90 * 86400 THEN 'stale' WHEN stamp IS NULL THEN 'no stamp' ELSE 'kept' END"


def feed_buckets(spark, sf_dir):
    """Every row of a feed in exactly one bucket; the counts."""
    b = feeds.bucketed(_feed(spark, sf_dir), ["transport", "router"], (12.6, 51.7, 14.2, 53.2), NOW, 90, 7)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


SQL["feed_buckets"] = f"WITH {_FEED} SELECT {_BUCKET} AS bucket, count(*) AS n FROM feed GROUP BY 1"


def feed_newest(spark, sf_dir):
    """Kept rows, the newest of each key at its first row's place; rows without a key all stay."""
    b = feeds.bucketed(_feed(spark, sf_dir), ["transport", "router"], (12.6, 51.7, 14.2, 53.2), NOW, 90, 7).filter("bucket = 'kept'")
    return feeds.newest(b, "key", "stamp", "id").select("place", "id", "key", "stamp")


SQL["feed_newest"] = f"WITH {_FEED}, k AS (SELECT * FROM (SELECT *, {_BUCKET} AS bucket FROM feed) WHERE bucket = 'kept'), r AS (SELECT *, CASE WHEN key = '' THEN 'row' || id ELSE key END AS g FROM k), m AS (SELECT *, min(id) OVER (PARTITION BY g) AS place, row_number() OVER (PARTITION BY g ORDER BY stamp DESC NULLS LAST, id) AS n FROM r) SELECT place, id, key, stamp FROM m WHERE n = 1"


def last_row_per_id(spark, sf_dir):
    """The last row of each key; blank keys are exempt."""
    return feeds.last_rows(_feed(spark, sf_dir), "key", "id").select("id", "key")


SQL["last_row_per_id"] = f"WITH {_FEED} SELECT id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS k FROM feed) WHERE k = 1 OR key = ''"


def node_selection(spark, sf_dir):
    """A selection by the algebra of facts: transport nodes or BUILDING ones, but for low ids, symmetric difference with routers."""
    pick = ((node(role="transport") | node(tag="BUILDING")) - node(id=[1, 2, 3])) ^ node(role="router")
    return pick.of(bridge.nodes(spark, sf_dir)).select("id", "name")


SQL["node_selection"] = f"WITH {NODES} SELECT id, name FROM nodes WHERE ((role = 'transport' OR tag = 'BUILDING') AND NOT id IN (1, 2, 3)) <> (role = 'router')"


def rules_last_match(spark, sf_dir):
    """The last rule that fits decides; a default before all."""
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.lit(t).alias("tag"), F.lit(f).alias("fw")) for i, (r, t, f) in enumerate([("", "", "base"), ("router", "", "relay"), ("", "MACHINERY", "quiet"), ("transport", "BUILDING", "tower")])])
    fit = F.filter(rules, lambda x: ((x["role"] == "") | (x["role"] == F.col("role"))) & ((x["tag"] == "") | (x["tag"] == F.col("tag"))))
    return bridge.nodes(spark, sf_dir).select("id", F.element_at(fit, -1)["fw"].alias("firmware"))


SQL["rules_last_match"] = f"WITH {NODES}, r(i, rr, rt, fw) AS (VALUES (0, '', '', 'base'), (1, 'router', '', 'relay'), (2, '', 'MACHINERY', 'quiet'), (3, 'transport', 'BUILDING', 'tower')) SELECT id, arg_max(fw, i) AS firmware FROM nodes JOIN r ON (rr = '' OR rr = role) AND (rt = '' OR rt = tag) GROUP BY id"


def node_summary(spark, sf_dir):
    """Per tag: nodes and extent."""
    return bridge.nodes(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


SQL["node_summary"] = f"WITH {NODES} SELECT tag, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM nodes GROUP BY tag"


def prefix_occupancy(spark, sf_dir):
    """Keys by prefixes of one, two and three bytes: prefixes in use, keys alone on theirs, the fullest prefix."""
    keys = bridge.nodes(spark, sf_dir).select(F.sha2(F.col("name"), 256).alias("k"))
    by = keys.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("bytes"), "k").groupBy("bytes", F.substring(F.col("k"), F.lit(1), F.col("bytes") * 2).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(F.col("bytes").cast("long").alias("bytes")).agg(F.count(F.lit(1)).alias("occupied"), F.count_if(F.col("n") == 1).alias("alone"), F.max("n").alias("worst"), F.round(F.count(F.lit(1)) / F.pow(F.lit(256.0), F.first("bytes")), 9).alias("chance"))


SQL["prefix_occupancy"] = f"WITH {NODES}, p AS (SELECT b, substr(sha256(name), 1, b * 2) AS p, count(*) AS n FROM nodes, range(1, 4) t(b) GROUP BY ALL) SELECT b AS bytes, count(*) AS occupied, count(*) FILTER (n = 1) AS alone, max(n) AS worst, round(count(*) / pow(256.0, b), 9) AS chance FROM p GROUP BY b"


def prefix_join(spark, sf_dir):
    """One-byte prefixes of the keys that sent a frame, and all nodes each can mean."""
    keys = bridge.nodes(spark, sf_dir).select("id", F.substring(F.sha2(F.col("name"), 256), 1, 2).alias("p"))
    senders = bridge.frames(spark, sf_dir).select(F.col("sid").alias("id")).distinct()
    heard = keys.join(senders, "id", "left_semi").select("p").distinct()
    return heard.join(keys, "p").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


SQL["prefix_join"] = f"WITH {bridge.FRAMES}, {NODES}, k AS (SELECT id, substr(sha256(name), 1, 2) AS p FROM nodes), h AS (SELECT DISTINCT p FROM k WHERE id IN (SELECT sid FROM frames)) SELECT p, count(*) AS n, min(id) AS first FROM h JOIN k USING (p) GROUP BY p"


def slugs(spark, sf_dir):
    return bridge.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.slug(F.concat_ws(" / ", "p_name", "p_brand"), F.lit("node")).alias("slug"))


SQL["slugs"] = "SELECT p_partkey AS id, rtrim(substr(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32), '-') AS slug FROM part"


def place_search(spark, sf_dir):
    """A ranked search of part names as places: best score first, then shorter names."""
    n = bridge.read(spark, sf_dir, "part").select("p_partkey", "p_name", text.place_key(F.col("p_name")).alias("k"))
    return n.withColumn("score", text.match_score(F.col("k"), F.lit("ar"))).filter("score IS NOT NULL").orderBy(F.desc("score"), F.length("p_name"), "p_partkey").limit(30).select("p_partkey", "k", "score")


SQL["place_search"] = "WITH n AS (SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS k FROM part), s AS (SELECT *, CAST(CASE WHEN k = 'ar' THEN 1000 ELSE CASE WHEN instr(k, 'ar') = 1 THEN 700 WHEN substr(k, instr(k, 'ar') - 1, 1) = ' ' THEN 500 ELSE 250 END - least(strlen(k) - 2, 200) END AS INTEGER) AS score FROM n WHERE instr(k, 'ar') > 0) SELECT p_partkey, k, score FROM s ORDER BY score DESC, length(p_name), p_partkey LIMIT 30"


def event_properties(spark, sf_dir):
    """Events whose JSON holds a key, found by text before it is parsed; bad JSON would be null."""
    e = bridge.read(spark, sf_dir, "events").filter(F.col("props").contains('"k"'))
    k = F.from_json("props", "k long")["k"]
    return e.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("low"), F.max(k).alias("high"))


SQL["event_properties"] = """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS low, max(k) AS high FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE contains(props, '"k"')) GROUP BY event_type"""


def record_lines(spark, sf_dir):
    """Events written as record lines with sorted keys and six decimals, and how many characters that is."""
    e = bridge.frames(spark, sf_dir)
    line = F.concat_ws("\t", F.format_string("%d.%06d", F.floor(F.col("t0") / 1000000), F.pmod(F.col("t0"), F.lit(1000000))), F.lit("in"), F.col("sid").cast("string"), F.to_json(F.struct("freq", F.col("power").alias("power_dbm"), "sf", F.col("t0").alias("t0"), F.col("t1").alias("t_end"), F.lit("tx").alias("type"))))
    return e.select("eid", F.length(line).cast("long").alias("chars"), F.sha2(line, 256).alias("digest"))


SQL["record_lines"] = f"""WITH {bridge.FRAMES}, l AS (SELECT eid, printf('%d.%06d', t0 // 1000000, t0 % 1000000) || chr(9) || 'in' || chr(9) || sid || chr(9) || '{{"freq":' || freq || ',"power_dbm":' || power || ',"sf":' || sf || ',"t0":' || t0 || ',"t_end":' || t1 || ',"type":"tx"}}' AS line FROM frames) SELECT eid, length(line) AS chars, sha256(line) AS digest FROM l"""


def tile_cover(spark, sf_dir):
    """The one-degree tiles that each region's rectangle needs, named by their south-west corner."""
    r = bridge.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7 % 60 - 20).alias("lat0"), (F.col("n_nationkey") * 11 % 90 - 30).alias("lon0"))
    t = r.withColumn("lat", F.explode(F.sequence(F.col("lat0"), F.col("lat0") + 2))).withColumn("lon", F.explode(F.sequence(F.col("lon0"), F.col("lon0") + 1)))
    return t.select("k", text.tile_name(F.col("lat"), F.col("lon")).alias("tile"), text.utm_zone(F.col("lon") + F.lit(0.5)).cast("long").alias("zone"))


SQL["tile_cover"] = "WITH r AS (SELECT n_nationkey AS k, n_nationkey * 7 % 60 - 20 AS lat0, n_nationkey * 11 % 90 - 30 AS lon0 FROM nation) SELECT k, (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS tile, CAST(least(60, greatest(1, floor((lon + 0.5 + 180) / 6) + 1)) AS BIGINT) AS zone FROM (SELECT k, lat0 + i AS lat, lon0 + j AS lon FROM r, range(3) a(i), range(2) b(j))"


def merged_layers(spark, sf_dir):
    """Suppliers laid over customers: a supplier within 400 m of a customer is that customer."""
    s = bridge.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 4241 % 20000).alias("x"), (F.col("s_suppkey") * 15013 % 20000).alias("y"))
    c = bridge.nodes(spark, sf_dir).select("id", "name", "x", "y")
    return feeds.merged(c, s, 400).groupBy((F.col("id") >= 10_000_000).alias("supplier")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


SQL["merged_layers"] = f"WITH {NODES}, s AS (SELECT s_suppkey + 10000000 AS id, s_suppkey * 4241 % 20000 AS x, s_suppkey * 15013 % 20000 AS y FROM supplier), c AS (SELECT id, x, y FROM nodes), m AS (SELECT id FROM c UNION ALL SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 160000)) SELECT id >= 10000000 AS supplier, count(*) AS n, max(id) AS last FROM m GROUP BY 1"


def loss_offsets(spark, sf_dir):
    """Pair losses with offsets added: offsets by unordered pair, summed, both ways."""
    n = bridge.stations(spark, sf_dir).select("id")
    cells = pairs.every(n.withColumnRenamed("id", "a"), n.withColumnRenamed("id", "b")).filter("a <> b").select("a", "b", ((F.col("a") * 31 + F.col("b") * 17) % 60 + 80).alias("loss"))
    # at most 780 pairs of residues: broadcast, so the matrix isn't shuffled
    off = bridge.frames(spark, sf_dir).select((F.col("eid") % 40).alias("p"), (F.col("eid") * 7 % 40).alias("q"), (F.col("eid") % 3).alias("db")).filter("p <> q").groupBy(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.sum("db").alias("db"))
    return cells.join(F.broadcast(off), (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left").select("a", "b", (F.col("loss") + F.coalesce("db", F.lit(0))).cast("long").alias("loss"))


SQL["loss_offsets"] = f"WITH {bridge.FRAMES}, n AS (SELECT s_suppkey AS id FROM supplier), c AS (SELECT a.id AS a, b.id AS b, (a.id * 31 + b.id * 17) % 60 + 80 AS loss FROM n a JOIN n b ON a.id <> b.id), o AS (SELECT least(p, q) AS lo, greatest(p, q) AS hi, sum(db) AS db FROM (SELECT eid % 40 AS p, eid * 7 % 40 AS q, eid % 3 AS db FROM frames) WHERE p <> q GROUP BY 1, 2) SELECT a, b, CAST(loss + coalesce(db, 0) AS BIGINT) AS loss FROM c LEFT JOIN o ON least(a, b) = lo AND greatest(a, b) = hi"


def first_turns(spark, sf_dir):
    """First row per conversation and role."""
    c = bridge.read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", "role").agg(F.min(F.struct("turn", F.length("text").alias("n"))).alias("m")).select("conv_id", "role", F.col("m.turn").alias("turn"), F.col("m.n").cast("long").alias("n"))


SQL["first_turns"] = "SELECT conv_id, role, turn, n FROM (SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, length(text)) AS k FROM conversations) WHERE k = 1"


def station_union(spark, sf_dir):
    """Stations known as nodes, as senders, or both."""
    a = bridge.nodes(spark, sf_dir).select(F.col("id").alias("sid"), F.lit(1).alias("n"))
    b = bridge.frames(spark, sf_dir).select("sid", F.lit(2).alias("n")).distinct()
    return a.unionByName(b).groupBy("sid").agg(F.sum("n").alias("known"))


SQL["station_union"] = f"WITH {bridge.FRAMES} SELECT sid, CAST(sum(n) AS BIGINT) AS known FROM (SELECT c_custkey AS sid, 1 AS n FROM customer UNION ALL SELECT DISTINCT sid, 2 FROM frames) GROUP BY sid"


def segment_ranks(spark, sf_dir):
    """The newest three nodes of each tag."""
    w = W.partitionBy("tag").orderBy(F.desc("heard"), "id")
    return bridge.nodes(spark, sf_dir).withColumn("k", F.row_number().over(w).cast("long")).filter("k <= 3").select("tag", "k", "id", "heard")


SQL["segment_ranks"] = f"WITH {NODES} SELECT tag, k, id, heard FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY heard DESC, id) AS k FROM nodes) WHERE k <= 3"

QUERIES = {name: fn for name, fn in list(globals().items()) if callable(fn) and getattr(fn, "__module__", "") == __name__ and not name.startswith("_")}
