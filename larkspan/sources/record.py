"""Event records: tab-separated stamp, direction, station and JSON message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "type string, t bigint, t0 bigint, t_end bigint, t_pre bigint, t_hdr bigint, id bigint, slot int, freq bigint, bw bigint, sf int, sync int, power_dbm double, payload string, verdict string, mode string, epoch bigint, slots array<int>, level int, rssi int, snr int, cad boolean"


def stamp_seconds(stamp: Column) -> Column:
    """A stamp's seconds: the number itself, or the time of day of an ISO stamp."""
    clock = F.split(F.regexp_replace(F.element_at(F.split(stamp, "T"), -1), r"[+Z].*$", ""), ":")
    day = F.get(clock, F.lit(0)).try_cast("int") * 3600 + F.get(clock, F.lit(1)).try_cast("int") * 60 + F.get(clock, F.lit(2)).try_cast("double")
    return F.when(F.instr(stamp, ":") == 0, stamp.try_cast("double")).otherwise(day)


def read_record(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """line_no, stamp, at, dir, sid, msg. Comments, lines without exactly four fields, and bad stations or JSON are left out.

    With types, lines are tested for the type's text before their JSON is
    parsed. line_no orders lines within a file; it isn't consecutive.
    """
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value").filter(~F.col("value").startswith("#"))
    if types is not None:
        raw = raw.filter(F.col("value").rlike("|".join(f'"type": ?"{t}"' for t in types)))
    parts = F.split("value", "\t", -1)
    sid = F.get(parts, F.lit(2)).try_cast("int")
    rows = raw.filter(F.size(parts) == 4).select("line_no", F.get(parts, F.lit(0)).alias("stamp"), F.get(parts, F.lit(1)).alias("dir"), sid.alias("sid"), F.get(parts, F.lit(3)).alias("json"))
    parsed = F.from_json("json", MESSAGE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("msg", parsed).filter("sid IS NOT NULL AND msg IS NOT NULL AND msg._bad IS NULL")
    return rows.withColumn("at", stamp_seconds(F.col("stamp"))).select("line_no", "stamp", "at", "dir", "sid", F.col("msg").dropFields("_bad").alias("msg"))


def epoch(record: DataFrame) -> DataFrame:
    """epoch: of the first welcome; null without one."""
    return record.filter("msg.type = 'welcome'").agg(F.min_by("msg.epoch", "line_no").alias("epoch"))


def last_instant(record: DataFrame) -> DataFrame:
    return record.filter("msg.t IS NOT NULL").agg(F.max_by("msg.t", "line_no").alias("t"))


def transmissions(record: DataFrame) -> DataFrame:
    """line_no, sid, t0, t1, freq, bw, sf, power, payload of tx messages that say when they were sent."""
    tx = record.filter("dir = 'in' AND msg.type = 'tx' AND msg.t0 IS NOT NULL AND msg.t_end IS NOT NULL")
    return tx.select("line_no", "sid", F.col("msg.t0").alias("t0"), F.col("msg.t_end").alias("t1"), F.coalesce("msg.freq", F.lit(0)).alias("freq"), F.coalesce("msg.bw", F.lit(125_000)).alias("bw"), "msg.sf", F.col("msg.power_dbm").alias("power"), "msg.payload")


def received(record: DataFrame) -> DataFrame:
    """rx, id, t0, t1, verdict, payload: each begin (not mere energy) with its end at the same station, joined with the frame sent then; tx is null if none was."""
    begin = record.filter("msg.type = 'rx_begin' AND NOT coalesce(msg.cad, false)").select(F.col("sid").alias("rx"), "msg.id", F.col("msg.t0").alias("t0"), F.col("msg.t_end").alias("t1"))
    end = record.filter("msg.type = 'rx_end'").select(F.col("sid").alias("rx"), "msg.id", "msg.verdict", "msg.payload")
    sent = transmissions(record).groupBy("t0", "payload").agg(F.max_by("sid", "line_no").alias("tx"))
    both = begin.join(end, ["rx", "id"])
    return both.join(sent, (both["t0"] == sent["t0"]) & both["payload"].eqNullSafe(sent["payload"]), "left").select("rx", "id", both["t0"], "t1", "verdict", both["payload"], "tx")


def record_lines(messages: DataFrame) -> DataFrame:
    """value: lines of a record from (at, dir, sid, msg); msg's fields are written in alphabetical order, nulls left out."""
    names = sorted(messages.schema["msg"].dataType.fieldNames())
    return messages.select(F.concat_ws("\t", F.format_string("%.6f", F.col("at")), "dir", F.col("sid").cast("string"), F.to_json(F.struct(*[F.col(f"msg.{n}").alias(n) for n in names]))).alias("value"))
