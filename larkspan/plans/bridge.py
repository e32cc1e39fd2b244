"""Views of the driver tables as radio data: frames, receptions, nodes, cells.

Each view has a DataFrame and the same thing as a SQL common table expression,
built from integers and floor() only, so that both engines agree to the bit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Carriers in Hz by event type.
CARRIERS = {"click": 869_525_000, "error": 869_100_000, "purchase": 868_300_000, "signup": 867_500_000, "view": 433_500_000}
CALLING = 869_525_000
#: How many stations the made-up receptions are dealt over.
RECEIVERS = 150
#: Longest frame in microseconds, for bucketed joins.
LONGEST = 600_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, sid, t0, span, t1 (microseconds), freq, bw, sf, power, kind."""
    freq = F.lit(None).cast("long")
    for kind, hz in CARRIERS.items():
        freq = F.when(F.col("event_type") == kind, F.lit(hz).cast("long")).otherwise(freq)
    span = F.floor(F.col("value") * 1000000).cast("long") + 100000
    t0 = F.unix_micros(F.col("ts").cast("timestamp"))
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("eid"), F.col("user_id").alias("sid"), t0.alias("t0"), span.alias("span"), (t0 + span).alias("t1"), freq.alias("freq"), F.lit(125000).cast("long").alias("bw"), (e % 6 + 7).cast("long").alias("sf"), (e % 7 * 3 + 2).cast("long").alias("power"), F.col("event_type").alias("kind")
    )


FRAMES = f"""frames AS (SELECT event_id AS eid, user_id AS sid, epoch_us(ts) AS t0,
  CAST(floor(value * 1000000) AS BIGINT) + 100000 AS span, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) + 100000 AS t1,
  CAST(CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in CARRIERS.items())} END AS BIGINT) AS freq, CAST(125000 AS BIGINT) AS bw,
  CAST(event_id % 6 + 7 AS BIGINT) AS sf, CAST(event_id % 7 * 3 + 2 AS BIGINT) AS power, event_type AS kind FROM events)"""


def receptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, tx, rx, level, verdict: two stations that hear each frame."""
    f = frames(spark, sf_dir).select("eid", F.col("sid").alias("tx"), F.explode(F.array(F.lit(1), F.lit(2))).alias("j"))
    rx = (F.col("tx") + F.col("j") * (F.col("eid") % 11 + 1)) % RECEIVERS
    return f.select("eid", "tx", rx.cast("long").alias("rx"), (F.col("eid") * 13 % 40 - 130).cast("long").alias("level"), F.when((F.col("eid") + F.col("j")) % 5 == 0, "crc").otherwise("clean").alias("verdict"))


RECEPTIONS = f"""receptions AS (SELECT eid, sid AS tx, CAST((sid + j * (eid % 11 + 1)) % {RECEIVERS} AS BIGINT) AS rx,
  CAST(eid * 13 % 40 - 130 AS BIGINT) AS level, CASE WHEN (eid + j) % 5 = 0 THEN 'crc' ELSE 'clean' END AS verdict
  FROM frames, (VALUES (1), (2)) v(j))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, x, y (metres), role, tag, heard (seconds)."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), (k * 7919 % 20000).alias("x"), (k * 104729 % 20000).alias("y"),
        F.when(k % 3 == 0, "transport").when(k % 7 == 0, "router").otherwise("client").alias("role"), F.col("c_mktsegment").alias("tag"), (F.lit(1_700_000_000) + k * 86_400 % 17_280_000).cast("long").alias("heard"),
    )


NODES = """nodes AS (SELECT c_custkey AS id, c_name AS name, c_custkey * 7919 % 20000 AS x, c_custkey * 104729 % 20000 AS y,
  CASE WHEN c_custkey % 3 = 0 THEN 'transport' WHEN c_custkey % 7 = 0 THEN 'router' ELSE 'client' END AS role,
  c_mktsegment AS tag, CAST(1700000000 + c_custkey * 86400 % 17280000 AS BIGINT) AS heard FROM customer)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y (metres) of the backbone, whose loss tables and hops are matrices of it."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), (k * 4241 % 20000).cast("long").alias("x"), (k * 15013 % 20000).cast("long").alias("y"))


STATIONS = "stations AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey * 4241 % 20000 AS BIGINT) AS x, CAST(s_suppkey * 15013 % 20000 AS BIGINT) AS y FROM supplier)"


def side(spark: SparkSession, sf_dir: str) -> int:
    """Cells in a row of the grid, which is as square as the table allows."""
    return max(1, math.ceil(math.sqrt(read(spark, sf_dir, "orders").count())))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v: a grid with a cell for each order, so that it grows with the table; v is an integer."""
    n, k = side(spark, sf_dir), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.floor(k / n).alias("row"), (k % n).alias("col"), (F.floor("o_totalprice").cast("long") % 101 - 20).alias("v"))


CELLS = """side AS (SELECT greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS side FROM orders),
cells AS (SELECT o_orderkey // side AS row, o_orderkey % side AS col, CAST(floor(o_totalprice) AS BIGINT) % 101 - 20 AS v FROM orders, side)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, row, col: a site for each supplier."""
    n, k = side(spark, sf_dir), F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("site"), (k * 53 % n).alias("row"), (k * 29 % n).alias("col"))


SITES = "sites AS (SELECT s_suppkey AS site, s_suppkey * 53 % side AS row, s_suppkey * 29 % side AS col FROM supplier, side)"
#: Cells are numbered row * WIDE + col where one number is needed.
WIDE = 10_000_000
