"""Readers of node lists, field logs and ground files. Bad rows are counted or dropped as stated, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspan.functions.text import rfc3339_seconds, slug

#: Names a field-log column goes by.
RANGE_COLUMNS = {
    "snr": ["rx snr", "snr"],
    "lat": ["rx lat", "lat", "latitude"],
    "lon": ["rx long", "rx lon", "long", "lon", "longitude"],
    "time": ["time", "timestamp", "date"],
    "tx": ["from", "tx"],
    "sender": ["sender name", "sender"],
    "tx_lat": ["sender lat", "tx lat"],
    "tx_lon": ["sender long", "sender lon", "tx lon"],
    "rssi": ["rx rssi", "rssi"],
}


def csv_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header that may be written as a comment, all columns as text, with row (from 1, in file order)."""
    first = next((r[0] for r in spark.read.text(path).filter("trim(value) <> ''").head(1)), "")
    names = [h.strip().strip('"').lstrip("\ufeff") for h in first.lstrip("#").strip().split(sep)]
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("_n", F.monotonically_increasing_id()).filter(F.col("value") != first)
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.select("_n", F.from_csv("value", F.lit(schema), {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return rows.withColumn("row", F.row_number().over(W.orderBy("_n")).cast("long")).select("row", "r.*")


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def read_sites(spark: SparkSession, path: str, prefix: str = "site", height: float = 2.0) -> DataFrame:
    """id, name, lat, lon, height_m, height_from, max_dbm. Rows without a position are left out but keep their number in the names."""
    rows = csv_rows(spark, path).withColumn("lat", _number("lat")).withColumn("lon", _number("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    ident = F.row_number().over(W.orderBy("row")).cast("long")
    power = F.greatest(F.lit(-9.0), F.least(F.lit(27.0), _number("tx_power_dbm")))
    return rows.select(ident.alias("id"), F.concat(F.lit(prefix + "-"), F.lpad(F.col("row").cast("string"), 3, "0")).alias("name"), "lat", "lon", F.lit(height).alias("height_m"), F.lit("assumed").alias("height_from"), F.when(_number("tx_power_dbm").isNotNull(), power).alias("max_dbm"))


def read_nodes(spark: SparkSession, path: str, height: float = 15.0) -> DataFrame:
    """id, name, kind, lat, lon, height_m, height_from, max_dbm of a deployed network's list. Names are made usable and, within equal ones, numbered by row."""
    rows = csv_rows(spark, path).withColumn("lat", _number("lat")).withColumn("lon", _number("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    rows = rows.withColumn("nid", F.row_number().over(W.orderBy("row")).cast("long"))
    rows = rows.withColumn("base", slug(F.col("name"), F.concat(F.lit("n"), F.lpad(F.col("nid").cast("string"), 3, "0"))))
    k = F.row_number().over(W.partitionBy("base").orderBy("row"))
    tail = F.concat(F.lit("-"), k.cast("string"))
    name = F.when(k == 1, F.col("base")).otherwise(F.concat(F.rtrim(F.expr("substring(base, 1, 32 - length(concat('-', cast(row_number() over (partition by base order by row) as string))))"), F.lit("-")), tail))
    tall = _number("height_agl_m")
    power = F.greatest(F.lit(-9.0), F.least(F.lit(27.0), _number("tx_power_dbm")))
    return rows.select(F.col("nid").alias("id"), name.alias("name"), slug(F.col("kind"), F.lit("")).alias("kind"), "lat", "lon", F.coalesce(tall, F.lit(height)).alias("height_m"), F.when(tall.isNotNull(), "measured").otherwise("assumed").alias("height_from"), F.when(_number("tx_power_dbm").isNotNull(), power).alias("max_dbm"))


def read_range_test(spark: SparkSession, path: str) -> DataFrame:
    """time, tx, tx_lat, tx_lon, lat, lon, snr, rssi; rows without a usable position or snr are left out, a sender at 0, 0 is unknown. ValueError if a needed column is missing."""
    rows = csv_rows(spark, path)
    names = {c.strip().lower().replace("_", " ").replace("-", " "): c for c in rows.columns if c != "row"}
    found = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in RANGE_COLUMNS.items()}
    for k in ("snr", "lat", "lon"):
        if found[k] is None:
            raise ValueError(f"no column for {k}: one of {RANGE_COLUMNS[k]}")
    text = lambda k: F.trim(F.col(f"`{found[k]}`")) if found[k] else F.lit(None).cast("string")
    number = lambda k: text(k).try_cast("double")
    held = rows.select("row", text("time").try_cast("long").alias("time"), F.coalesce(F.nullif(text("tx"), F.lit("")), text("sender"), F.lit("")).alias("tx"), number("tx_lat").alias("tx_lat"), number("tx_lon").alias("tx_lon"), number("lat").alias("lat"), number("lon").alias("lon"), number("snr").alias("snr"), number("rssi").alias("rssi"))
    known = ~((F.col("tx_lat") == 0) & (F.col("tx_lon") == 0)) & F.col("tx_lat").between(-90, 90) & F.col("tx_lon").between(-180, 180)
    held = held.filter("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND snr IS NOT NULL")
    return held.withColumn("tx_lat", F.when(known, F.col("tx_lat"))).withColumn("tx_lon", F.when(known & F.col("tx_lat").isNotNull(), F.col("tx_lon"))).drop("row")


SENSING = "kind string, id string, lat double, lon double, h_agl_m double, ant_gain_dbi double, t bigint, rssi double, snr double, sf int, bw double, src string, route string, hops_travelled int, hops_remaining int"


def read_sensing(spark: SparkSession, path: str) -> DataFrame:
    """line_no, session (from 1; 0 before any), what (session, rx, broken or bad), r. A reading without a finite rssi is broken; what isn't JSON is bad."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("value")).filter("value <> '' AND NOT startswith(value, '#')")
    r = F.from_json("value", SENSING + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = raw.withColumn("r", r)
    broken = F.col("r.rssi").isNull() | F.isnan("r.rssi") | (F.abs(F.col("r.rssi")) == float("inf"))
    what = F.when(F.col("r._bad").isNotNull() | ~F.coalesce(F.col("r.kind").isin("session", "rx"), F.lit(False)), "bad").when(F.col("r.kind") == "session", "session").when(broken, "broken").otherwise("rx")
    rows = rows.withColumn("what", what)
    return rows.withColumn("session", F.sum((F.col("what") == "session").cast("long")).over(W.orderBy("line_no"))).select("line_no", "session", "what", F.col("r").dropFields("_bad").alias("r"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A public map's JSON array as a feed: key, kind, name, lat, lon, stamp. No row is rejected; 0, 0 and impossible positions are none."""
    schema = "public_key string, type double, adv_name string, last_advert string, adv_lat double, adv_lon double"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    kinds = F.create_map(F.lit(1.0), F.lit("companion"), F.lit(2.0), F.lit("repeater"), F.lit(3.0), F.lit("room-server"), F.lit(4.0), F.lit("sensor"))
    there = F.col("adv_lat").between(-90, 90) & F.col("adv_lon").between(-180, 180) & ~((F.col("adv_lat") == 0) & (F.col("adv_lon") == 0))
    return rows.select(F.coalesce("public_key", F.lit("")).alias("key"), F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("unknown")).alias("kind"), F.col("adv_name").alias("name"), F.when(there, F.col("adv_lat")).alias("lat"), F.when(there, F.col("adv_lon")).alias("lon"), rfc3339_seconds(F.col("last_advert")).alias("stamp"))


NODE_LIST = "node_id string, num bigint, short_name string, long_name string, role string, last_heard bigint, location_source string, precision_bits bigint, latitude double, longitude double, altitude double, lora_freq double, modem_preset string, protocol string"
#: What a node list's roles are called here; other roles are lower-cased with dashes.
ROLES = {
    "repeater": ["REPEATER"],
    "room-server": ["ROOM_SERVER", "ROOM"],
    "companion": ["COMPANION", "CHAT"],
    "router": ["ROUTER", "ROUTER_LATE", "ROUTER_CLIENT"],
    "client": ["CLIENT", "CLIENT_MUTE", "CLIENT_HIDDEN", "CLIENT_BASE", "TAK"],
    "tracker": ["TRACKER", "TAK_TRACKER", "LOST_AND_FOUND"],
    "sensor": ["SENSOR"],
}
#: Positions with fewer bits were blurred on purpose.
WHOLE_POSITION_BITS = 30


def read_node_list(spark: SparkSession, path: str) -> DataFrame:
    """A node list's JSON array: row, key, num, kind, name, lat, lon, quality (unknown, truncated, fixed or gps), stamp, and the list's own radio columns. No row is rejected."""
    rows = spark.read.schema(NODE_LIST).option("multiLine", "true").json(path).withColumn("row", F.monotonically_increasing_id())
    there = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    role = F.upper("role")
    kind = F.when(role.isNotNull(), F.lower(F.regexp_replace("role", "_", "-"))).otherwise("unknown")
    for name, roles in ROLES.items():
        kind = F.when(role.isin(roles), name).otherwise(kind)
    bits = F.col("precision_bits")
    installed = (F.lower("protocol") == "meshcore") & role.isin("REPEATER", "ROOM_SERVER")
    quality = F.when(~F.coalesce(there, F.lit(False)), "unknown").when(bits < WHOLE_POSITION_BITS, "truncated").when(F.upper("location_source").contains("MANUAL"), "fixed").when(bits.isNotNull(), "gps").when(installed, "fixed").otherwise("unknown")
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select("row", F.col("node_id").alias("key"), "num", kind.alias("kind"), F.coalesce(named("long_name"), named("short_name"), F.lit("")).alias("name"), F.when(there, F.col("latitude")).alias("lat"), F.when(there, F.col("longitude")).alias("lon"), quality.alias("quality"), F.col("last_heard").alias("stamp"), "altitude", "lora_freq", "modem_preset", "protocol")


def _sightings(links: DataFrame, nodes: DataFrame, rssi: Column) -> DataFrame:
    """Observations of links (tx, rx, rx_time, snr) with the positions of both ends, where known."""
    last = nodes.groupBy("key").agg(F.max_by(F.struct("lat", "lon", "quality"), "row").alias("n"))
    end = lambda side: last.select(F.col("key").alias(side), F.col("n").alias(f"{side}_n"))
    held = links.join(end("tx"), "tx", "left").join(end("rx"), "rx", "left")
    return held.select(F.col("rx_time").alias("time"), "tx", "rx", F.col("tx_n.lat").alias("tx_lat"), F.col("tx_n.lon").alias("tx_lon"), F.col("rx_n.lat").alias("rx_lat"), F.col("rx_n.lon").alias("rx_lon"), F.coalesce("rx_n.quality", F.lit("unknown")).alias("quality"), F.col("snr").cast("float").alias("snr"), rssi.cast("float").alias("rssi"))


def read_neighbours(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Observations of a neighbour list: its reporter heard its neighbour. Ends that nodes (read_node_list) doesn't hold have no position; of rows with one key the last counts."""
    rows = spark.read.schema("node_id string, neighbor_id string, snr double, rx_time bigint").option("multiLine", "true").json(path)
    return _sightings(rows.select(F.col("neighbor_id").alias("tx"), F.col("node_id").alias("rx"), "rx_time", "snr"), nodes, F.lit(None))


def read_traces(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Observations of traced routes' two ends, by number; a trace with an end that no node has is left out."""
    rows = spark.read.schema("src bigint, dest bigint, rx_time bigint, rssi double, snr double").option("multiLine", "true").json(path)
    ids = nodes.filter("num IS NOT NULL").groupBy("num").agg(F.max_by("key", "row").alias("key"))
    held = rows.join(ids.select(F.col("num").alias("src"), F.col("key").alias("tx")), "src").join(ids.select(F.col("num").alias("dest"), F.col("key").alias("rx")), "dest")
    return _sightings(held, nodes, F.col("rssi"))


def read_hop_reports(spark: SparkSession, glob: str) -> DataFrame:
    """hops, paths: the sum over every station's report of its line "by hops: h:n ..."."""
    pairs = spark.read.text(glob).select(F.explode(F.regexp_extract_all(F.regexp_extract("value", r"by hops:((?:\s*\d+:\d+)+)", 1), F.lit(r"(\d+:\d+)"), F.lit(1))).alias("p"))
    part = lambda i: F.split_part("p", F.lit(":"), F.lit(i)).cast("long")
    return pairs.groupBy(part(1).alias("hops")).agg(F.sum(part(2)).alias("paths"))


def read_refractivity(spark: SparkSession, path: str, rows: int = 121, cols: int = 241) -> DataFrame:
    """row, col, v of a world map of whitespace-separated numbers, its size checked. The size is the format's, so a task holds it."""
    text = spark.read.text(path, wholetext=True)
    v = F.transform(F.filter(F.split("value", r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double"))
    checked = F.when((F.size(v) == rows * cols) & ~F.exists(v, lambda x: x.isNull()), v).otherwise(F.raise_error(F.lit(f"the map isn't {rows} by {cols} numbers")))
    return text.select(F.posexplode(checked).alias("k", "v")).select(F.floor(F.col("k") / cols).cast("int").alias("row"), (F.col("k") % cols).alias("col"), "v")


def read_logs(spark: SparkSession, glob: str, epoch_s: float, year: int) -> DataFrame:
    """node, mid, delivered (first, seconds after the epoch), last (the last line's words), from station logs <node>/log."""
    raw = spark.read.text(glob).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("node"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\x1b\\[[0-9;]*m", "").alias("line")).filter(F.col("line").contains("mid=o_"))
    stamp = F.regexp_extract("line", r"^([A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d\.\d+)", 1)
    mid = F.regexp_extract("line", r"mid=(o_\w+)", 1)
    at = F.unix_micros(F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(stamp, " +", " ")), F.lit("yyyy MMM d HH:mm:ss.SSS"))) / 1e6 - epoch_s
    rows = raw.select("node", "n", mid.alias("mid"), at.alias("at"), F.expr(r"substring(line, length(regexp_extract(line, '^([A-Z][a-z]{2} +\\d+ \\d\\d:\\d\\d:\\d\\d\\.\\d+)', 1)) + 1)").alias("words"), F.col("line").contains("delivered mid=").alias("done")).filter("mid <> '' AND at IS NOT NULL")
    return rows.groupBy("node", "mid").agg(F.min_by(F.when(F.col("done"), F.col("at")), F.when(F.col("done"), F.col("n"))).alias("delivered"), F.max_by("words", "n").alias("last"))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """x, y, people of a census grid; header, malformed and non-positive rows are left out."""
    parts = F.split("value", ";")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return spark.read.text(path).select(number(1).alias("x"), number(2).alias("y"), number(3).alias("people")).filter("x IS NOT NULL AND y IS NOT NULL AND people > 0")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of whitespace-separated lidar points; malformed lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= 3).select(*[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")]).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
