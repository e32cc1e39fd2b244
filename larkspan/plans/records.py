"""From record lines to reports: frames are written as a record, read again as text, and judged from that alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import frames as classes
from larkspan.functions.stats import ranked_quantiles
from larkspan.operators import intervals
from larkspan.plans import bridge
from larkspan.plans.bridge import CALLING, FRAMES, NODES, RECEPTIONS
from larkspan.plans.reports import GAP, ON, on_calling
from larkspan.plans.storage import cut, scratch
from larkspan.sources import record

SQL: dict[str, str] = {}
#: Payloads by eid modulo their number, without the last bytes, which are the eid's: what follows the first byte of a packet is flags, hops, an address of 16 bytes, a context.
ADDRESS = "00112233445566778899aabbccddeeff"
PAYLOADS = [("c2", "SUPE HAIL"), ("c4", "SUPE GOT"), ("00" + "08" + "00" + ADDRESS + "00", "data"), ("00" + "09" + "01" + ADDRESS + "00" + "ab" * 80, "announce other"), ("00" + "0a" + "00" + ADDRESS + "00", "link request"), ("00" + "0b" + "00" + ADDRESS + "ff", "link proof")]
EPOCH = 1_700_000_000_000_000


def _payload():
    head = F.get(F.array(*[F.lit(p) for p, _ in PAYLOADS]), (F.col("eid") % len(PAYLOADS)).cast("int"))
    return F.base64(F.unhex(F.concat(head, F.lpad(F.hex("eid"), 10, "0"))))


def _messages(spark, sf_dir):
    """at, dir, sid, msg of a run: its welcome, every frame sent, and the begin and end of every reception."""
    f = bridge.frames(spark, sf_dir).withColumn("payload", _payload())
    r = bridge.receptions(spark, sf_dir).join(f.select("eid", "t0", "t1", "payload"), "eid")
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {"bw": "bigint", "cad": "boolean", "epoch": "bigint", "freq": "bigint", "id": "bigint", "mode": "string", "payload": "string", "power_dbm": "double", "sf": "int", "t0": "bigint", "t_end": "bigint", "type": "string", "verdict": "string"}

    def rows(df, at, direction, sid, **fields):
        msg = F.struct(*[(fields[k].cast(t) if k in fields else null(t)).alias(k) for k, t in kinds.items()])
        return df.select((at / 1_000_000.0).alias("at"), F.lit(direction).alias("dir"), sid.cast("int").alias("sid"), msg.alias("msg"))

    c = F.col
    welcome = rows(spark.range(1), F.lit(0), "out", F.lit(0), type=F.lit("welcome"), epoch=F.lit(EPOCH), mode=F.lit("virtual"))
    sent = rows(f, c("t0"), "in", c("sid"), type=F.lit("tx"), t0=c("t0"), t_end=c("t1"), freq=c("freq"), power_dbm=c("power"), sf=c("sf"), bw=c("bw"), payload=c("payload"))
    begin = rows(r, c("t0"), "out", c("rx"), type=F.lit("rx_begin"), id=c("eid"), t0=c("t0"), t_end=c("t1"))
    energy = rows(r, c("t0"), "out", c("rx"), type=F.lit("rx_begin"), id=-c("eid") - 1, t0=c("t0"), t_end=c("t1"), cad=F.lit(True))
    end = rows(r, c("t1"), "out", c("rx"), type=F.lit("rx_end"), id=c("eid"), verdict=c("verdict"), payload=c("payload"))
    return welcome.unionByName(sent).unionByName(begin).unionByName(energy).unionByName(end)


def _record(spark, sf_dir):
    path = scratch(spark) + "/record"
    record.record_lines(_messages(spark, sf_dir)).write.text(path)
    return record.read_record(spark, path, ["tx", "rx_begin", "rx_end"])


def _frames(spark, sf_dir):
    """The record's frames: sid, t0, span, freq, power, kind, and how many got them, cleanly or damaged."""
    read = cut(_record(spark, sf_dir))
    sent = record.transmissions(read)
    sent = sent.withColumn("kind", classes.kind_of(F.unbase64("payload"), F.lit(0)))
    heard = record.received(read).filter("tx IS NOT NULL").groupBy("t0", "payload").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "clean").alias("clean"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sent.join(heard, ["t0", "payload"], "left").select("sid", "t0", "t1", (F.col("t1") - F.col("t0")).alias("span"), "freq", "power", "kind", zero("n"), zero("clean"))


_KIND = "CASE eid % " + str(len(PAYLOADS)) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(PAYLOADS)) + " END"
_F = f"{FRAMES}, f AS (SELECT *, {_KIND} AS kind2 FROM frames)"


def record_losses(spark, sf_dir):
    """What became of a record's frames: receptions clean and damaged, frames heard, lost at every receiver, heard by nobody."""
    f = _frames(spark, sf_dir)
    return f.agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("receptions"), F.sum("clean").alias("clean"), F.sum(F.col("n") - F.col("clean")).alias("crc"), F.count_if(F.col("n") > 0).alias("heard"), F.count_if((F.col("n") > 0) & (F.col("clean") == 0)).alias("lost"), F.count_if(F.col("n") == 0).alias("nobody"))


SQL["record_losses"] = f"""WITH {FRAMES}, {RECEPTIONS}, r AS (SELECT eid, count(*) AS n, count(*) FILTER (verdict = 'clean') AS clean FROM receptions GROUP BY eid), j AS (SELECT coalesce(n, 0) AS n, coalesce(clean, 0) AS clean FROM frames LEFT JOIN r USING (eid))
SELECT count(*) AS frames, CAST(sum(n) AS BIGINT) AS receptions, CAST(sum(clean) AS BIGINT) AS clean, CAST(sum(n - clean) AS BIGINT) AS crc, count(*) FILTER (n > 0) AS heard, count(*) FILTER (n > 0 AND clean = 0) AS lost, count(*) FILTER (n = 0) AS nobody FROM j"""


def record_kinds(spark, sf_dir):
    """A record's frames and airtime by class, on the calling channel and in all."""
    on = on_calling(F.col("freq"))
    return _frames(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("frames"), F.sum("span").alias("us"), F.count_if(on).alias("calling_frames"), F.sum(F.when(on, F.col("span")).otherwise(0)).alias("calling_us"))


SQL["record_kinds"] = f"WITH {_F} SELECT kind2 AS kind, count(*) AS frames, CAST(sum(span) AS BIGINT) AS us, count(*) FILTER ({ON}) AS calling_frames, CAST(sum(CASE WHEN {ON} THEN span ELSE 0 END) AS BIGINT) AS calling_us FROM f GROUP BY kind2"


def record_airtime(spark, sf_dir):
    """A record's airtime: window, totals, announcements, mean over all stations, silent ones included, and the station with most (the first of equals)."""
    f = cut(_frames(spark, sf_dir))
    on = on_calling(F.col("freq"))
    whole = f.agg((F.max("t1") - F.min("t0")).alias("window_us"), F.sum("span").alias("total_us"), F.sum(F.when(on, F.col("span")).otherwise(0)).alias("calling_us"), F.sum(F.when(classes.is_announce(F.col("kind")), F.col("span")).otherwise(0)).alias("announce_us"))
    names = bridge.nodes(spark, sf_dir).select(F.col("id").alias("sid"), "name")
    each = names.join(f.groupBy("sid").agg(F.sum("span").alias("us")), "sid", "full_outer").select("sid", "name", F.coalesce("us", F.lit(0)).alias("us"))
    top = each.agg(F.count(F.lit(1)).alias("stations"), F.max(F.struct("us", (-F.col("sid")).alias("s"), F.coalesce("name", F.col("sid").cast("string")).alias("name"))).alias("top"))
    w = F.col("window_us")
    return whole.crossJoin(top).select(  # one row each
        "window_us", "total_us", "calling_us", "announce_us", (F.col("total_us") - F.col("announce_us")).alias("other_us"), "stations", F.round(F.col("total_us") / F.col("stations"), 6).alias("mean_us"), F.col("top.us").alias("most_us"), F.col("top.name").alias("most_name"),
        F.round(F.col("total_us") / F.col("stations") / w, 12).alias("mean_fraction"), F.round(F.col("top.us") / w, 12).alias("most_fraction"),
    )


SQL["record_airtime"] = f"""WITH {_F}, {NODES}, w AS (SELECT max(t1) - min(t0) AS window_us, sum(span) AS total_us, sum(CASE WHEN {ON} THEN span ELSE 0 END) AS calling_us, sum(CASE WHEN kind2 LIKE 'announce%' THEN span ELSE 0 END) AS announce_us FROM f),
s AS (SELECT sid, sum(span) AS us FROM f GROUP BY sid), e AS (SELECT coalesce(n.id, s.sid) AS sid, coalesce(name, CAST(coalesce(n.id, s.sid) AS VARCHAR)) AS name, coalesce(us, 0) AS us FROM nodes n FULL JOIN s ON n.id = s.sid), t AS (SELECT * FROM e ORDER BY us DESC, sid LIMIT 1), c AS (SELECT count(*) AS stations FROM e)
SELECT window_us, CAST(total_us AS BIGINT) AS total_us, CAST(calling_us AS BIGINT) AS calling_us, CAST(announce_us AS BIGINT) AS announce_us, CAST(total_us - announce_us AS BIGINT) AS other_us, stations, round(total_us / stations, 6) AS mean_us, CAST(t.us AS BIGINT) AS most_us, t.name AS most_name,
round(total_us / stations / window_us, 12) AS mean_fraction, round(t.us / window_us, 12) AS most_fraction FROM w, t, c"""


def record_exchanges(spark, sf_dir):
    """A record's exchanges off the calling channel: how many, how many with a frame below the highest power, and their mean number of frames."""
    f = cut(_frames(spark, sf_dir))
    top = f.agg(F.max("power").alias("top"))
    s = intervals.gap_sessions(f.filter(~on_calling(F.col("freq"))).select("freq", "t0", "t1", "sid", "power"), ["freq"], GAP, ["sid", "t1"])
    each = s.groupBy("freq", "session").agg(F.count(F.lit(1)).alias("frames"), F.min("power").alias("least")).crossJoin(top)  # one row
    return each.agg(F.count(F.lit(1)).alias("exchanges"), F.count_if(F.col("least") < F.col("top")).alias("reduced"), F.round(F.sum("frames") / F.count(F.lit(1)), 6).alias("frames_mean"))


SQL["record_exchanges"] = f"""WITH {_F}, a AS (SELECT *, CASE WHEN t0 - lag(t1) OVER w > {GAP} OR lag(t1) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM f WHERE NOT {ON} WINDOW w AS (PARTITION BY freq ORDER BY t0, sid, t1)),
b AS (SELECT *, sum(n) OVER (PARTITION BY freq ORDER BY t0, sid, t1 ROWS UNBOUNDED PRECEDING) AS session FROM a), e AS (SELECT freq, session, count(*) AS frames, min(power) AS least FROM b GROUP BY freq, session)
SELECT count(*) AS exchanges, count(*) FILTER (least < (SELECT max(power) FROM f)) AS reduced, round(sum(frames) / count(*), 6) AS frames_mean FROM e"""


def _busy(spark, sf_dir):
    """Busy time on the calling channel per station; a reception's carrier is that of the frame that began then and was as long."""
    read = cut(_record(spark, sf_dir))
    sent = record.transmissions(read)
    carrier = sent.groupBy("t0", "t1").agg(F.max_by("freq", "line_no").alias("freq"))
    begun = read.filter("msg.type = 'rx_begin' AND NOT coalesce(msg.cad, false)").select(F.col("sid").alias("st"), F.col("msg.t0").alias("t0"), F.col("msg.t_end").alias("t1")).join(carrier, ["t0", "t1"])
    both = begun.unionByName(sent.select(F.col("sid").alias("st"), "t0", "t1", "freq")).filter(on_calling(F.col("freq")))
    window = sent.agg((F.max("t1") - F.min("t0")).alias("window_us"))
    return intervals.union_length(both, ["st"]).crossJoin(window).select("st", F.round(F.col("busy") / F.col("window_us"), 12).alias("share"))  # one row


def record_busy(spark, sf_dir):
    """The share of a record's time that stations find the calling channel busy: five nearest-rank numbers and the mean."""
    b = cut(_busy(spark, sf_dir)).withColumn("scope", F.lit("calling"))
    five = ranked_quantiles(b, ["scope"], "share", {"low": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "high": 1.0})
    return five.join(b.groupBy("scope").agg(F.count(F.lit(1)).alias("stations"), F.round(F.sum("share") / F.count(F.lit(1)), 10).alias("mean")), "scope")


# frames that begin together and are as long share a carrier only by the last one's; the driver's frames have that at most by chance, and the SQL takes the largest eid
_B = f"""{FRAMES}, {RECEPTIONS}, k AS (SELECT t0, t1, max(freq) AS freq, count(DISTINCT freq) AS n FROM frames GROUP BY ALL), i AS (SELECT rx AS st, t0, t1 FROM receptions JOIN frames USING (eid) JOIN k USING (t0, t1) WHERE abs(k.freq - {CALLING}) <= 31250 UNION ALL SELECT sid, t0, t1 FROM frames WHERE {ON}),
m AS (SELECT *, max(t1) OVER (PARTITION BY st ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i), u AS (SELECT st, sum(greatest(0, t1 - greatest(t0, coalesce(r, t0)))) AS busy FROM m GROUP BY st),
b AS (SELECT st, round(busy / (SELECT max(t1) - min(t0) FROM frames), 12) AS share FROM u)"""
SQL["record_busy"] = f"""WITH {_B}, q AS (SELECT list_sort(list(share)) AS p, count(*) AS n, sum(share) AS total FROM b)
SELECT 'calling' AS scope, n AS stations, round(total / n, 10) AS mean, p[1] AS low, p[CAST(floor(0.25 * (n - 1) + 0.5) AS INT) + 1] AS q1, p[CAST(floor(0.5 * (n - 1) + 0.5) AS INT) + 1] AS middle, p[CAST(floor(0.75 * (n - 1) + 0.5) AS INT) + 1] AS q3, p[n] AS high FROM q"""


def record_busiest(spark, sf_dir):
    """The five stations that find the calling channel busy most, of equals the smaller first."""
    return _busy(spark, sf_dir).orderBy(F.desc("share"), "st").limit(5)


SQL["record_busiest"] = f"WITH {_B} SELECT st, share FROM b ORDER BY share DESC, st LIMIT 5"

QUERIES = {name: globals()[name] for name in SQL}
