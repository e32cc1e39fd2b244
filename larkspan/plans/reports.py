"""Reports over frames and receptions: airtime, power, exchanges, compliance, links, delivery, comparison, verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspan.functions import radio
from larkspan.functions.stats import ranked_quantiles
from larkspan.operators import interference, intervals, pairs
from larkspan.operators.medium import PAIRWISE_DB
from larkspan.plans import bridge
from larkspan.plans.bridge import CALLING, FRAMES, LONGEST, NODES, RECEPTIONS
from larkspan.plans.storage import cut

HOUR = 3_600_000_000
GAP = 60_000_000
#: Regulatory entries: low Hz, high Hz, e.r.p. limit in mW, duty cycle in thousandths.
ENTRIES = [(433_050_000, 434_790_000, 10, 100), (863_000_000, 865_000_000, 25, 1), (865_000_000, 868_000_000, 25, 10), (868_000_000, 868_600_000, 25, 10), (868_700_000, 869_200_000, 25, 1), (869_400_000, 869_650_000, 500, 100), (869_700_000, 870_000_000, 25, 10)]
EDGE_HZ, DBD = 1000, 2.15
#: Spreading-factor rejection as rows of a table: sf, other, dB.
_MATRIX = ", ".join(f"({7 + i}, {7 + j}, {x})" for i, r in enumerate(radio.INTER_SF_DB) for j, x in enumerate(r))
SQL: dict[str, str] = {}


def on_calling(freq):
    return F.abs(freq - CALLING) <= 31_250


ON = f"abs(freq - {CALLING}) <= 31250"


def airtime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airtime per station, silent ones included: on the calling channel and off it."""
    f = bridge.frames(spark, sf_dir)
    on = on_calling(F.col("freq"))
    totals = f.groupBy("sid").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.when(on, F.col("span")).otherwise(0)).alias("calling_us"), F.sum(F.when(on, 0).otherwise(F.col("span"))).alias("other_us"))
    s = bridge.nodes(spark, sf_dir).select(F.col("id").alias("sid"), "name")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return s.join(totals, "sid", "left").select("sid", "name", zero("frames"), zero("calling_us"), zero("other_us"), (F.coalesce("calling_us", F.lit(0)) + F.coalesce("other_us", F.lit(0))).cast("long").alias("total_us"))


SQL["airtime_report"] = f"""WITH {FRAMES}, {NODES}, t AS (SELECT sid, count(*) AS frames, sum(CASE WHEN {ON} THEN span ELSE 0 END) AS c, sum(CASE WHEN {ON} THEN 0 ELSE span END) AS o FROM frames GROUP BY sid)
SELECT id AS sid, name, CAST(coalesce(frames, 0) AS BIGINT) AS frames, CAST(coalesce(c, 0) AS BIGINT) AS calling_us, CAST(coalesce(o, 0) AS BIGINT) AS other_us, CAST(coalesce(c, 0) + coalesce(o, 0) AS BIGINT) AS total_us
FROM nodes LEFT JOIN t ON id = t.sid"""


def airtime_carrier(spark, sf_dir):
    """Airtime by carrier in tenths of a MHz, rounded half to even."""
    tenth = (F.bround(F.col("freq") / 100000.0)).cast("long")
    return bridge.frames(spark, sf_dir).groupBy(tenth.alias("mhz_tenths")).agg(F.sum("span").alias("us"), F.count(F.lit(1)).alias("frames"))


SQL["airtime_carrier"] = f"WITH {FRAMES} SELECT CAST(round_even(freq / 100000.0, 0) AS BIGINT) AS mhz_tenths, CAST(sum(span) AS BIGINT) AS us, count(*) AS frames FROM frames GROUP BY 1"


def airtime_kind(spark, sf_dir):
    """Frames and airtime by kind, all and on the calling channel, as grouping sets."""
    f = bridge.frames(spark, sf_dir).withColumn("calling", on_calling(F.col("freq")))
    sums = f.groupingSets([["kind"], ["kind", "calling"]], "kind", "calling").agg(F.grouping("calling").cast("long").alias("all_channels"), F.count(F.lit(1)).alias("frames"), F.sum("span").alias("us"))
    return sums.select("kind", F.coalesce(F.col("calling").cast("int"), F.lit(-1)).alias("calling"), "all_channels", "frames", "us")


SQL["airtime_kind"] = f"WITH {FRAMES}, k AS (SELECT kind, {ON} AS calling, span FROM frames) SELECT kind, coalesce(CAST(calling AS INT), -1) AS calling, CAST(grouping(calling) AS BIGINT) AS all_channels, count(*) AS frames, CAST(sum(span) AS BIGINT) AS us FROM k GROUP BY GROUPING SETS ((kind), (kind, calling))"


def airtime_role(spark, sf_dir):
    """Per role of the sender: stations, frames, airtime, and airtime per carrier in use off the calling channel."""
    f = bridge.frames(spark, sf_dir).join(bridge.nodes(spark, sf_dir).select(F.col("id").alias("sid"), "role"), "sid")
    off = ~on_calling(F.col("freq"))
    return f.groupBy("role").agg(F.countDistinct("sid").alias("stations"), F.count(F.lit(1)).alias("frames"), F.sum("span").alias("us"), F.countDistinct(F.when(off, F.col("freq"))).alias("channels"), F.sum(F.when(off, F.col("span"))).alias("traffic_us"))


SQL["airtime_role"] = f"WITH {FRAMES}, {NODES} SELECT role, count(DISTINCT sid) AS stations, count(*) AS frames, CAST(sum(span) AS BIGINT) AS us, count(DISTINCT CASE WHEN NOT {ON} THEN freq END) AS channels, CAST(sum(CASE WHEN NOT {ON} THEN span END) AS BIGINT) AS traffic_us FROM frames JOIN nodes ON id = sid GROUP BY role"


def power_summary(spark, sf_dir):
    """Transmit power by channel group: mean by frame and by airtime, five nearest-rank numbers, frames below the maximum."""
    f = bridge.frames(spark, sf_dir).withColumn("scope", F.when(on_calling(F.col("freq")), "calling").otherwise("other"))
    five = ranked_quantiles(f, ["scope"], "power", {"low": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "high": 1.0})
    sums = f.groupBy("scope").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("power") / F.count(F.lit(1)), 6).alias("mean_by_frame"), F.round(F.sum(F.col("power") * F.col("span")) / F.sum("span"), 6).alias("mean_by_airtime"), F.count_if(F.col("power") < 20).alias("below_max"))
    return sums.join(five, "scope")


SQL["power_summary"] = f"""WITH {FRAMES}, f AS (SELECT *, CASE WHEN {ON} THEN 'calling' ELSE 'other' END AS scope FROM frames),
q AS (SELECT scope, list_sort(list(power)) AS p FROM f GROUP BY scope),
s AS (SELECT scope, count(*) AS frames, round(sum(power) / count(*), 6) AS mean_by_frame, round(sum(power * span) / sum(span), 6) AS mean_by_airtime, count(*) FILTER (power < 20) AS below_max FROM f GROUP BY scope)
SELECT s.*, p[1] AS low, p[CAST(floor(0.25 * (len(p) - 1) + 0.5) AS INT) + 1] AS q1, p[CAST(floor(0.5 * (len(p) - 1) + 0.5) AS INT) + 1] AS middle, p[CAST(floor(0.75 * (len(p) - 1) + 0.5) AS INT) + 1] AS q3, p[len(p)] AS high FROM s JOIN q USING (scope)"""


def window_frames(spark, sf_dir):
    """A half-open time window of frames, its length from the frames themselves, and frames by kind."""
    lo, hi = 1_704_844_800_000_000, 1_705_449_600_000_000
    f = bridge.frames(spark, sf_dir).filter((F.col("t0") >= lo) & (F.col("t0") < hi))
    return f.groupBy("kind").agg(F.count(F.lit(1)).alias("frames"), (F.max("t1") - F.min("t0")).alias("length_us"))


SQL["window_frames"] = f"WITH {FRAMES} SELECT kind, count(*) AS frames, max(t1) - min(t0) AS length_us FROM frames WHERE t0 >= 1704844800000000 AND t0 < 1705449600000000 GROUP BY kind"


def exchanges(spark, sf_dir):
    """Exchanges per carrier: runs of frames whose pauses are short."""
    s = intervals.gap_sessions(bridge.frames(spark, sf_dir), ["freq"], GAP, ["eid"])
    return s.groupBy("freq", "session").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("frames"), F.countDistinct("sid").alias("stations"))


SQL["exchanges"] = f"""WITH {FRAMES}, a AS (SELECT *, CASE WHEN t0 - lag(t1) OVER w > {GAP} OR lag(t1) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM frames WINDOW w AS (PARTITION BY freq ORDER BY t0, eid)),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY freq ORDER BY t0, eid ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM a)
SELECT freq, session, min(t0) AS t0, max(t1) AS t1, count(*) AS frames, count(DISTINCT sid) AS stations FROM b GROUP BY freq, session"""


def exchange_summary(spark, sf_dir):
    e = exchanges(spark, sf_dir)
    return e.groupBy("freq").agg(F.count(F.lit(1)).alias("exchanges"), F.max("frames").alias("longest"), F.round(F.sum("frames") / F.count(F.lit(1)), 6).alias("mean_frames"))


SQL["exchange_summary"] = f"SELECT freq, count(*) AS exchanges, max(frames) AS longest, round(sum(frames) / count(*), 6) AS mean_frames FROM ({SQL['exchanges']}) GROUP BY freq"


def busy_share(spark, sf_dir):
    """Busy time per station: the union of what it sends and hears."""
    f = bridge.frames(spark, sf_dir)
    heard = bridge.receptions(spark, sf_dir).select("eid", F.col("rx").alias("st")).join(f.select("eid", "t0", "t1"), "eid")
    both = heard.select("st", "t0", "t1").unionByName(f.select(F.col("sid").alias("st"), "t0", "t1"))
    return intervals.union_length(both, ["st"])


SQL["busy_share"] = f"""WITH {FRAMES}, {RECEPTIONS}, i AS (SELECT rx AS st, t0, t1 FROM receptions JOIN frames USING (eid) UNION ALL SELECT sid, t0, t1 FROM frames),
m AS (SELECT *, max(t1) OVER (PARTITION BY st ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i)
SELECT st, CAST(sum(greatest(0, t1 - greatest(t0, coalesce(r, t0)))) AS BIGINT) AS busy FROM m GROUP BY st"""


def top_busy(spark, sf_dir):
    """The five busiest stations."""
    return busy_share(spark, sf_dir).orderBy(F.desc("busy"), "st").limit(5)


SQL["top_busy"] = f"SELECT * FROM ({SQL['busy_share']}) ORDER BY busy DESC, st LIMIT 5"


def loss_summary(spark, sf_dir):
    """Receptions by verdict, frames heard somewhere, lost everywhere, and heard by nobody."""
    r = bridge.receptions(spark, sf_dir).groupBy("eid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "clean").alias("clean"))
    j = bridge.frames(spark, sf_dir).select("eid").join(r, "eid", "left")
    return j.agg(F.sum("n").alias("receptions"), F.sum("clean").alias("clean"), F.sum(F.col("n") - F.col("clean")).alias("crc"), F.count_if(F.col("clean") > 0).alias("heard"), F.count_if((F.col("n") > 0) & (F.col("clean") == 0)).alias("lost"), F.count_if(F.col("n").isNull()).alias("nobody"))


SQL["loss_summary"] = f"""WITH {FRAMES}, {RECEPTIONS}, r AS (SELECT eid, count(*) AS n, count(*) FILTER (verdict = 'clean') AS clean FROM receptions GROUP BY eid)
SELECT CAST(sum(n) AS BIGINT) AS receptions, CAST(sum(clean) AS BIGINT) AS clean, CAST(sum(n - clean) AS BIGINT) AS crc, count(*) FILTER (clean > 0) AS heard, count(*) FILTER (n > 0 AND clean = 0) AS lost, count(*) FILTER (n IS NULL) AS nobody FROM frames LEFT JOIN r USING (eid)"""


def worst_hour(spark, sf_dir):
    """The hour with most time on the air, per station and carrier."""
    return intervals.worst_window(bridge.frames(spark, sf_dir), ["sid", "freq"], HOUR)


SQL["worst_hour"] = f"""WITH {FRAMES}, m AS (SELECT sid, freq, lo, min(kind) AS kind FROM (SELECT sid, freq, t0 AS lo, 0 AS kind FROM frames UNION ALL SELECT sid, freq, t1 - {HOUR}, 1 FROM frames) GROUP BY ALL),
o AS (SELECT m.sid, m.freq, lo, m.kind, sum(greatest(0, least(t1, lo + {HOUR}) - greatest(t0, lo))) AS on_air FROM m JOIN frames f ON f.sid = m.sid AND f.freq = m.freq AND f.t0 < lo + {HOUR} AND f.t1 > lo GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sid, freq ORDER BY on_air DESC, kind, lo) AS k FROM o)
SELECT sid, freq, CAST(on_air AS BIGINT) AS worst, lo AS worst_from FROM r WHERE k = 1"""


def compliance(spark, sf_dir):
    """Per station and regulatory entry: frames, worst hour against the duty cycle, radiated power against the limit."""
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("entry"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(mw).cast("long").alias("mw"), F.lit(duty).cast("long").alias("duty")) for i, (lo, hi, mw, duty) in enumerate(ENTRIES)])
    half = F.floor(F.col("bw") / 2)
    fits = lambda e: (F.col("freq") - half >= e["lo"] - EDGE_HZ) & (F.col("freq") + half <= e["hi"] + EDGE_HZ)
    f = bridge.frames(spark, sf_dir).withColumn("e", F.get(F.filter(rows, fits), F.lit(0))).filter("e IS NOT NULL")
    f = f.select("sid", "t0", "t1", "power", F.col("e.entry").alias("entry"), F.col("e.mw").alias("mw"), F.col("e.duty").alias("duty"))
    worst = intervals.worst_window(f, ["sid", "entry"], HOUR).select("sid", "entry", "worst")
    sums = f.groupBy("sid", "entry", "mw", "duty").agg(F.count(F.lit(1)).alias("frames"), F.max("power").alias("power"))
    erp = F.round(F.col("power") + 2.0 - DBD, 2)
    return sums.join(worst, ["sid", "entry"]).select("sid", "entry", "frames", "worst", (F.col("duty") * (HOUR // 1000)).alias("allowed"), (F.col("worst") <= F.col("duty") * (HOUR // 1000)).alias("time_ok"), erp.alias("erp_dbm"), (erp <= F.round(radio.dbm(F.col("mw").cast("double")), 6) + 0.005).alias("power_ok"))


_ENTRY = "(VALUES " + ", ".join(f"({i}, {lo}, {hi}, {mw}, {duty})" for i, (lo, hi, mw, duty) in enumerate(ENTRIES)) + ") en(entry, lo, hi, mw, duty)"
SQL["compliance"] = f"""WITH {FRAMES}, f AS (SELECT sid, t0, t1, power, entry, mw, duty FROM (SELECT frames.*, en.*, row_number() OVER (PARTITION BY eid ORDER BY entry) AS k FROM frames JOIN {_ENTRY} ON freq - bw // 2 >= en.lo - {EDGE_HZ} AND freq + bw // 2 <= en.hi + {EDGE_HZ}) WHERE k = 1),
m AS (SELECT DISTINCT sid, entry, unnest([t0, t1 - {HOUR}]) AS lo FROM f),
o AS (SELECT m.sid, m.entry, m.lo, sum(greatest(0, least(t1, m.lo + {HOUR}) - greatest(t0, m.lo))) AS on_air FROM m JOIN f ON f.sid = m.sid AND f.entry = m.entry AND t0 < m.lo + {HOUR} AND t1 > m.lo GROUP BY ALL),
w AS (SELECT sid, entry, CAST(max(on_air) AS BIGINT) AS worst FROM o GROUP BY sid, entry),
s AS (SELECT sid, entry, mw, duty, count(*) AS frames, max(power) AS power FROM f GROUP BY ALL)
SELECT sid, CAST(entry AS BIGINT) AS entry, frames, worst, CAST(duty * {HOUR // 1000} AS BIGINT) AS allowed, worst <= duty * {HOUR // 1000} AS time_ok, round(CAST(power AS DOUBLE) + 2.0 - {DBD}, 2) AS erp_dbm, round(CAST(power AS DOUBLE) + 2.0 - {DBD}, 2) <= round(10.0 * log10(CAST(mw AS DOUBLE)), 6) + 0.005 AS power_ok FROM s JOIN w USING (sid, entry)"""


def shortest_pause(spark, sf_dir):
    return intervals.shortest_pause(bridge.frames(spark, sf_dir), ["sid"])


SQL["shortest_pause"] = f"WITH {FRAMES}, p AS (SELECT sid, lead(t0) OVER (PARTITION BY sid ORDER BY t0, t1) - t1 AS p FROM frames) SELECT sid, min(p) AS pause FROM p GROUP BY sid"


def overlap_pairs(spark, sf_dir):
    """Pairs of frames that share the air: overlapping in time, channels overlapping in frequency."""
    f = bridge.frames(spark, sf_dir)
    both = intervals.overlaps(f, "eid", lambda a, b: radio.in_band(a["freq"], a["bw"], b["freq"], b["bw"]), LONGEST, band=("freq", "bw"))
    return both.select(F.col("a.eid").alias("a"), F.col("b.eid").alias("b"), (F.least("a.t1", "b.t1") - F.greatest("a.t0", "b.t0")).alias("shared_us"))


_PAIRS = "SELECT x.eid AS a, y.eid AS b, least(x.t1, y.t1) - greatest(x.t0, y.t0) AS shared_us FROM frames x JOIN frames y ON x.eid < y.eid AND x.t0 < y.t1 AND y.t0 < x.t1 AND abs(x.freq - y.freq) < (x.bw + y.bw) / 2"
SQL["overlap_pairs"] = f"WITH {FRAMES} {_PAIRS}"


def _level(power, sid, rx):
    """A made-up path loss of the bridge data: dBm at a receiver, from integers."""
    return (F.col(power) - (F.lit(80) + (F.col(sid) * 31 + F.col(rx) * 17) % 60)).cast("double")


def interference_pieces(spark, sf_dir):
    """Each frame's air cut where the frames that share it begin or end."""
    f = bridge.frames(spark, sf_dir)
    p = intervals.overlaps(f, "eid", lambda a, b: radio.in_band(a["freq"], a["bw"], b["freq"], b["bw"]), LONGEST, band=("freq", "bw"))
    turned = p.select(F.col("a.eid").alias("eid"), F.col("b.t0").alias("o0"), F.col("b.t1").alias("o1")).unionByName(p.select(F.col("b.eid").alias("eid"), F.col("a.t0").alias("o0"), F.col("a.t1").alias("o1")))
    return intervals.pieces(f.select("eid", "t0", "t1"), turned, "eid")


SQL["interference_pieces"] = f"""WITH {FRAMES}, o AS (SELECT x.eid, x.t0, x.t1, y.t0 AS o0, y.t1 AS o1 FROM frames x JOIN frames y ON x.eid <> y.eid AND x.t0 < y.t1 AND y.t0 < x.t1 AND abs(x.freq - y.freq) < (x.bw + y.bw) / 2),
c AS (SELECT eid, unnest([t0, t1]) AS lo FROM frames UNION SELECT eid, e FROM (SELECT eid, t0, t1, unnest([o0, o1]) AS e FROM o) WHERE e > t0 AND e < t1),
l AS (SELECT eid, lo, lead(lo) OVER (PARTITION BY eid ORDER BY lo) AS hi FROM c) SELECT * FROM l WHERE hi IS NOT NULL"""


def _level_at(power, sid, rx):
    """The same over arrays; like SQL's, the remainder has the sign of what is divided."""
    return (power - (80 + np.fmod(sid * 31 + rx * 17, 60))).astype(np.float64)


def _beaten(level, dbm, sf, osf):
    """Whether receptions at a level lead interference of class osf by too little."""
    return np.round(level - dbm, 6) < radio.rejections(sf, osf)


def reception_verdicts(spark, sf_dir):
    """Verdict of each reception: below the modem's threshold, talked over, or too little lead over any class of interference on any piece of the frame's air."""
    f = bridge.frames(spark, sf_dir)
    r = bridge.receptions(spark, sf_dir).select("eid", "rx").distinct()
    cand = f.join(r, "eid").filter("sid <> rx").select("eid", "rx", "sf", "bw", _level("power", "sid", "rx").alias("level"))
    lost = interference.judged(f, r, LONGEST, _level_at, _beaten, radio.in_band).select("eid", "rx", F.lit(True).alias("lost"))
    deaf = F.round(F.col("level") - radio.noise_floor(F.col("bw")), 6) < radio.sensitivity(F.col("sf"))
    verdict = F.when(deaf | F.col("lost").isNotNull(), "crc").otherwise("clean")
    return cand.join(lost, ["eid", "rx"], "left").select("eid", "rx", "level", verdict.alias("verdict"))


_LEVEL = "CAST({p} - (80 + ({s} * 31 + rx * 17) % 60) AS DOUBLE)"
_SENS = "CASE c.sf " + " ".join(f"WHEN {k} THEN {v}" for k, v in radio.SENSITIVITY_DB.items()) + " ELSE -20.0 END"
SQL["reception_verdicts"] = f"""WITH {FRAMES}, {RECEPTIONS}, m(sf, osf, db) AS (VALUES {_MATRIX}),
c AS (SELECT DISTINCT eid, sid, rx, t0, t1, frames.sf, bw, freq, {_LEVEL.format(p='power', s='sid')} AS level FROM frames JOIN receptions USING (eid) WHERE sid <> rx),
o AS (SELECT c.eid, c.rx, c.t0, c.t1, c.sf, c.level, y.sid AS osid, y.sf AS osf, y.t0 AS o0, y.t1 AS o1, CAST(y.power - (80 + (y.sid * 31 + c.rx * 17) % 60) AS DOUBLE) AS against
  FROM c JOIN frames y ON y.eid <> c.eid AND c.t0 < y.t1 AND y.t0 < c.t1 AND abs(c.freq - y.freq) < (c.bw + y.bw) / 2),
e AS (SELECT eid, rx, unnest([t0, t1]) AS lo FROM c UNION SELECT eid, rx, e FROM (SELECT eid, rx, t0, t1, unnest([o0, o1]) AS e FROM o) WHERE e > t0 AND e < t1),
p AS (SELECT * FROM (SELECT eid, rx, lo, lead(lo) OVER (PARTITION BY eid, rx ORDER BY lo) AS hi FROM e) WHERE hi IS NOT NULL),
s AS (SELECT o.eid, o.rx, p.lo, o.sf, o.level, o.osf, sum(pow(10.0, against / 10.0)) AS mw FROM p JOIN o ON o.eid = p.eid AND o.rx = p.rx AND o0 < hi AND o1 > p.lo GROUP BY ALL),
b AS (SELECT DISTINCT eid, rx FROM s JOIN m USING (sf, osf) WHERE round(level - 10.0 * log10(mw), 6) < db),
t AS (SELECT DISTINCT eid, rx FROM o WHERE osid = rx)
SELECT c.eid, c.rx, c.level, CASE WHEN round(c.level - (-168.0 + 10.0 * log10(c.bw)), 6) < {_SENS} OR t.eid IS NOT NULL OR b.eid IS NOT NULL THEN 'crc' ELSE 'clean' END AS verdict
FROM c LEFT JOIN t ON t.eid = c.eid AND t.rx = c.rx LEFT JOIN b ON b.eid = c.eid AND b.rx = c.rx"""


def pairwise_verdicts(spark, sf_dir):
    """Verdict of each reception taken pair by pair: it must lead every frame on its carrier that the receiver hears."""
    f = bridge.frames(spark, sf_dir)
    cand = f.join(bridge.receptions(spark, sf_dir).select("eid", "rx").distinct(), "eid").filter("sid <> rx")
    level = lambda power, sid: (F.col(power) - (F.lit(80) + (F.col(sid) * 31 + F.col("rx") * 17) % 60)).cast("double")
    cand = cand.select("eid", "rx", "freq", "bw", level("power", "sid").alias("level"))
    p = intervals.overlaps(f, "eid", lambda a, b: radio.in_band(a["freq"], a["bw"], b["freq"], b["bw"]), LONGEST, band=("freq", "bw"))
    pick = lambda me, he: p.select(F.col(f"{me}.eid").alias("eid"), *[F.col(f"{he}.{c}").alias(f"o{c}") for c in ("sid", "freq", "bw", "sf", "power")])
    others = cand.join(pick("a", "b").unionByName(pick("b", "a")), "eid").withColumn("against", level("opower", "osid"))
    near = radio.same_carrier(F.col("freq"), F.col("ofreq"), F.greatest("bw", "obw"))
    beaten = near & radio.audible(F.col("against"), F.col("obw"), F.col("osf")) & (F.col("level") - F.col("against") < PAIRWISE_DB)
    bad = others.filter((F.col("osid") == F.col("rx")) | beaten).select("eid", "rx").distinct().withColumn("bad", F.lit(True))
    return cand.join(bad, ["eid", "rx"], "left").select("eid", "rx", F.when(F.col("bad"), "crc").otherwise("clean").alias("verdict"))


SQL["pairwise_verdicts"] = f"""WITH {FRAMES}, {RECEPTIONS}, c AS (SELECT DISTINCT eid, sid, rx, t0, t1, bw, freq, {_LEVEL.format(p='power', s='sid')} AS level FROM frames JOIN receptions USING (eid) WHERE sid <> rx),
o AS (SELECT c.eid, c.rx, c.level, c.freq, c.bw, y.sid AS osid, y.sf, y.freq AS ofreq, y.bw AS obw, CAST(y.power - (80 + (y.sid * 31 + c.rx * 17) % 60) AS DOUBLE) AS against FROM c JOIN frames y ON y.eid <> c.eid AND c.t0 < y.t1 AND y.t0 < c.t1 AND abs(c.freq - y.freq) < (c.bw + y.bw) / 2),
b AS (SELECT DISTINCT eid, rx FROM (SELECT *, {_SENS.replace('c.sf', 'sf')} AS s FROM o) WHERE osid = rx OR (abs(freq - ofreq) <= greatest(bw, obw) / 4.0 AND against >= -168.0 + 10.0 * log10(obw) + s AND level - against < {PAIRWISE_DB}))
SELECT c.eid, c.rx, CASE WHEN b.eid IS NULL THEN 'clean' ELSE 'crc' END AS verdict FROM c LEFT JOIN b USING (eid, rx)"""


def in_band_energy(spark, sf_dir):
    """Summed power in a receiver's band at each frame's start, and whether carrier sense calls the channel busy."""
    f = bridge.frames(spark, sf_dir)
    p = intervals.overlaps(f, "eid", lambda a, b: radio.in_band(a["freq"], a["bw"], b["freq"], b["bw"]), LONGEST, band=("freq", "bw"))
    at = p.select(F.col("a.eid").alias("eid"), F.col("a.t0").alias("t0"), F.col("b.t0").alias("o0"), F.col("b.t1").alias("o1"), F.col("b.power").alias("power")).unionByName(p.select(F.col("b.eid").alias("eid"), F.col("b.t0").alias("t0"), F.col("a.t0").alias("o0"), F.col("a.t1").alias("o1"), F.col("a.power").alias("power")))
    s = at.filter("o0 <= t0 AND o1 > t0").groupBy("eid").agg(F.sum(radio.milliwatts(F.col("power") - 110.0)).alias("mw"))
    return s.select("eid", F.round(radio.dbm(F.col("mw")), 6).alias("dbm"), (F.round(radio.dbm(F.col("mw")), 6) >= F.round(radio.sense_threshold(F.lit(125000)), 6)).alias("busy"))


SQL["in_band_energy"] = f"""WITH {FRAMES}, s AS (SELECT x.eid, sum(pow(10.0, (y.power - 110.0) / 10.0)) AS mw FROM frames x JOIN frames y ON x.eid <> y.eid AND y.t0 <= x.t0 AND y.t1 > x.t0 AND abs(x.freq - y.freq) < (x.bw + y.bw) / 2 GROUP BY x.eid)
SELECT eid, round(10.0 * log10(mw), 6) AS dbm, round(10.0 * log10(mw), 6) >= round(10.0 * log10(125.0) - 102.0, 6) AS busy FROM s"""


def usable_links(spark, sf_dir):
    """Links with three clean receptions or more, and whether the way back is one too."""
    up = bridge.receptions(spark, sf_dir).filter("verdict = 'clean' AND tx <> rx").groupBy("tx", "rx").agg(F.count(F.lit(1)).alias("clean")).filter("clean >= 3")
    back = up.select(F.col("tx").alias("rx"), F.col("rx").alias("tx"), F.lit(True).alias("b"))
    return up.join(back, ["tx", "rx"], "left").select("tx", "rx", "clean", F.coalesce("b", F.lit(False)).alias("both_ways"))


SQL["usable_links"] = f"""WITH {FRAMES}, {RECEPTIONS}, u AS (SELECT tx, rx, count(*) AS clean FROM receptions WHERE verdict = 'clean' AND tx <> rx GROUP BY tx, rx HAVING count(*) >= 3)
SELECT u.tx, u.rx, u.clean, b.tx IS NOT NULL AS both_ways FROM u LEFT JOIN u b ON b.tx = u.rx AND b.rx = u.tx"""


def _link_lengths(spark, sf_dir):
    n = bridge.nodes(spark, sf_dir).select("id", "x", "y")
    a, b = n.select(F.col("id").alias("tx"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select(F.col("id").alias("rx"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return usable_links(spark, sf_dir).join(a, "tx").join(b, "rx").withColumn("d2", d2)


_LENGTHS = f"({SQL['usable_links']}) u JOIN (SELECT c_custkey AS id, c_custkey * 7919 % 20000 AS x, c_custkey * 104729 % 20000 AS y FROM customer) a ON a.id = u.tx JOIN (SELECT c_custkey AS id, c_custkey * 7919 % 20000 AS x, c_custkey * 104729 % 20000 AS y FROM customer) b ON b.id = u.rx"
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def link_histogram(spark, sf_dir):
    """Links by length in bins of 1 km, empty bins included."""
    got = _link_lengths(spark, sf_dir).select(F.floor(F.sqrt(F.col("d2").cast("double")) / 1000).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = got.agg(F.max("bin").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("links"))


SQL["link_histogram"] = f"WITH h AS (SELECT CAST(floor(sqrt(CAST({_D2} AS DOUBLE)) / 1000) AS BIGINT) AS bin, count(*) AS n FROM {_LENGTHS} GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS links FROM (SELECT unnest(range(0, (SELECT max(bin) + 1 FROM h))) AS bin) r LEFT JOIN h ON h.bin = r.bin"


def neighbours(spark, sf_dir):
    """Per station: how many it reaches, the nearest and the farthest; 0 and nulls for those that reach nobody."""
    g = _link_lengths(spark, sf_dir).groupBy("tx").agg(F.count(F.lit(1)).alias("n"), F.min("d2").alias("near"), F.max("d2").alias("far"))
    m = lambda c: F.round(F.sqrt(F.col(c).cast("double")), 6)
    s = bridge.nodes(spark, sf_dir).select(F.col("id").alias("sid"))
    return s.join(g, s["sid"] == g["tx"], "left").select("sid", F.coalesce("n", F.lit(0)).cast("long").alias("n"), m("near").alias("nearest_m"), m("far").alias("farthest_m"))


SQL["neighbours"] = f"WITH g AS (SELECT u.tx, count(*) AS n, min({_D2}) AS near, max({_D2}) AS far FROM {_LENGTHS} GROUP BY u.tx) SELECT c_custkey AS sid, coalesce(n, 0) AS n, round(sqrt(CAST(near AS DOUBLE)), 6) AS nearest_m, round(sqrt(CAST(far AS DOUBLE)), 6) AS farthest_m FROM customer LEFT JOIN g ON g.tx = c_custkey"


def power_bins(spark, sf_dir):
    """Off the calling channel: frames and airtime by 2 dB steps, and the running share of airtime."""
    f = bridge.frames(spark, sf_dir).filter(~on_calling(F.col("freq")))
    g = f.groupBy((F.floor(F.col("power") / 2) * 2).alias("bin")).agg(F.count(F.lit(1)).alias("frames"), F.sum("span").alias("us"))
    return g.withColumn("upto", F.sum("us").over(W.orderBy("bin")))


SQL["power_bins"] = f"WITH {FRAMES}, g AS (SELECT power // 2 * 2 AS bin, count(*) AS frames, CAST(sum(span) AS BIGINT) AS us FROM frames WHERE NOT {ON} GROUP BY 1) SELECT *, CAST(sum(us) OVER (ORDER BY bin) AS BIGINT) AS upto FROM g"


def weighted_quantiles(spark, sf_dir):
    """Per carrier: the power at which the airtime sent so low first reaches a quarter, half and three quarters."""
    g = bridge.frames(spark, sf_dir).groupBy("freq", "power").agg(F.sum("span").alias("us"))
    w = W.partitionBy("freq").orderBy("power")
    c = g.withColumn("upto", F.sum("us").over(w)).withColumn("every", F.sum("us").over(W.partitionBy("freq")))
    first = lambda k, n: F.min(F.when(F.col("upto") * 4 >= F.col("every") * k, F.col("power"))).alias(n)
    return c.groupBy("freq").agg(first(1, "q1"), first(2, "middle"), first(3, "q3"))


SQL["weighted_quantiles"] = f"WITH {FRAMES}, g AS (SELECT freq, power, sum(span) AS us FROM frames GROUP BY ALL), c AS (SELECT *, sum(us) OVER (PARTITION BY freq ORDER BY power) AS upto, sum(us) OVER (PARTITION BY freq) AS every_us FROM g) SELECT freq, min(power) FILTER (upto * 4 >= every_us) AS q1, min(power) FILTER (upto * 4 >= every_us * 2) AS middle, min(power) FILTER (upto * 4 >= every_us * 3) AS q3 FROM c GROUP BY freq"


def common_setting(spark, sf_dir):
    """The most common spreading factor, bandwidth and power of a carrier; ties to the smaller."""
    g = bridge.frames(spark, sf_dir).groupBy("freq", "sf", "bw", "power").agg(F.count(F.lit(1)).alias("n"))
    top = g.groupBy("freq").agg(F.max(F.struct("n", (-F.col("sf")).alias("s"), (-F.col("bw")).alias("b"), (-F.col("power")).alias("p"))).alias("t"))
    return top.select("freq", (-F.col("t.s")).alias("sf"), (-F.col("t.b")).alias("bw"), (-F.col("t.p")).alias("power"), F.col("t.n").alias("n"))


SQL["common_setting"] = f"WITH {FRAMES}, g AS (SELECT freq, sf, bw, power, count(*) AS n FROM frames GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY freq ORDER BY n DESC, sf, bw, power) AS k FROM g) SELECT freq, sf, bw, power, n FROM r WHERE k = 1"


def station_counters(spark, sf_dir):
    """Per station: frames of each kind, as a pivot."""
    kinds = sorted(bridge.CARRIERS)
    return bridge.frames(spark, sf_dir).groupBy("sid").pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


SQL["station_counters"] = f"WITH {FRAMES} SELECT sid, {', '.join(f'''count(*) FILTER (kind = '{k}') AS {k}''' for k in sorted(bridge.CARRIERS))} FROM frames GROUP BY sid"


def collided(spark, sf_dir):
    """Frames of each sender that at least one receiver got damaged."""
    return bridge.receptions(spark, sf_dir).filter("verdict = 'crc'").groupBy("tx").agg(F.countDistinct("eid").alias("collided"))


SQL["collided"] = f"WITH {FRAMES}, {RECEPTIONS} SELECT tx, count(DISTINCT eid) AS collided FROM receptions WHERE verdict = 'crc' GROUP BY tx"


def best_paths(spark, sf_dir):
    """Per sender and receiver: the fewest hops, and when they were first that few."""
    r = bridge.receptions(spark, sf_dir).filter("verdict = 'clean'").join(bridge.frames(spark, sf_dir).select("eid", "t0", "sf"), "eid")
    return r.groupBy("tx", "rx").agg(F.min(F.struct("sf", "t0")).alias("m")).select("tx", "rx", F.col("m.sf").alias("hops"), F.col("m.t0").alias("first_us"))


SQL["best_paths"] = f"WITH {FRAMES}, {RECEPTIONS}, r AS (SELECT receptions.*, t0, sf, row_number() OVER (PARTITION BY tx, rx ORDER BY sf, t0) AS k FROM receptions JOIN frames USING (eid) WHERE verdict = 'clean') SELECT tx, rx, sf AS hops, t0 AS first_us FROM r WHERE k = 1"


def run_differences(spark, sf_dir):
    """Two runs (even and odd frames): pairs whose best path differs, or that only one has."""
    r = bridge.receptions(spark, sf_dir).filter("verdict = 'clean'").join(bridge.frames(spark, sf_dir).select("eid", "sf"), "eid")
    run = lambda k: r.filter(F.col("eid") % 2 == k).groupBy("tx", "rx").agg(F.min("sf").alias(f"run{k}"))
    return run(0).join(run(1), ["tx", "rx"], "full_outer").filter(~F.col("run0").eqNullSafe(F.col("run1"))).select("tx", "rx", F.coalesce("run0", F.lit(-1)).alias("run0"), F.coalesce("run1", F.lit(-1)).alias("run1"))


SQL["run_differences"] = f"WITH {FRAMES}, {RECEPTIONS}, r AS (SELECT tx, rx, eid % 2 AS k, min(sf) AS sf FROM receptions JOIN frames USING (eid) WHERE verdict = 'clean' GROUP BY ALL), a AS (SELECT * FROM r WHERE k = 0), b AS (SELECT * FROM r WHERE k = 1) SELECT coalesce(a.tx, b.tx) AS tx, coalesce(a.rx, b.rx) AS rx, coalesce(a.sf, -1) AS run0, coalesce(b.sf, -1) AS run1 FROM a FULL OUTER JOIN b ON a.tx = b.tx AND a.rx = b.rx WHERE a.sf IS DISTINCT FROM b.sf"


def milestones(spark, sf_dir):
    """When the last station was first heard, whether all were, and the first frame at each spreading factor."""
    f = bridge.frames(spark, sf_dir)
    first = f.groupBy("sid").agg(F.min("t0").alias("t"))
    every = bridge.stations(spark, sf_dir).select(F.col("id").alias("sid")).join(first, "sid", "left")
    whole = every.agg(F.count("t").alias("heard"), F.count(F.lit(1)).alias("stations"), F.max("t").alias("t")).select(F.lit("every station").alias("milestone"), "heard", F.when(F.col("heard") == F.col("stations"), F.col("t")).otherwise(-1).alias("t"))
    steps = f.groupBy("sf").agg(F.countDistinct("sid").alias("heard"), F.min("t0").alias("t")).select(F.concat(F.lit("first sf "), F.col("sf").cast("string")).alias("milestone"), "heard", "t")
    return whole.unionByName(steps)


SQL["milestones"] = f"WITH {FRAMES}, f AS (SELECT sid, min(t0) AS t FROM frames GROUP BY sid), e AS (SELECT count(t) AS heard, count(*) AS n, max(t) AS t FROM (SELECT s_suppkey AS sid FROM supplier) s LEFT JOIN f USING (sid)) SELECT 'every station' AS milestone, heard, CASE WHEN heard = n THEN t ELSE -1 END AS t FROM e UNION ALL SELECT 'first sf ' || sf, count(DISTINCT sid), min(t0) FROM frames GROUP BY sf"


def delivery(spark, sf_dir):
    """Messages (first turns) joined with their answers: sent, answered and the share, by length class of the message."""
    c = bridge.read(spark, sf_dir, "conversations")
    sent = c.filter("turn = 0").select("conv_id", F.when(F.length("text") < 200, "short").when(F.length("text") < 1000, "medium").otherwise("long").alias("cls"))
    done = c.filter("turn > 0").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    j = sent.join(done, "conv_id", "left")
    return j.groupBy("cls").agg(F.count(F.lit(1)).alias("sent"), F.count("turns").alias("ok"), F.max("turns").alias("most_turns"))


SQL["delivery"] = "WITH s AS (SELECT conv_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 1000 THEN 'medium' ELSE 'long' END AS cls FROM conversations WHERE turn = 0), d AS (SELECT conv_id, max(turn) AS turns FROM conversations WHERE turn > 0 GROUP BY conv_id) SELECT cls, count(*) AS sent, count(turns) AS ok, max(turns) AS most_turns FROM s LEFT JOIN d USING (conv_id) GROUP BY cls"


def radio_state_as_of(spark, sf_dir):
    """The kind of a station's last error or signup before or at each of its clicks."""
    f = bridge.frames(spark, sf_dir).select("eid", "sid", "t0", "kind")
    out = intervals.as_of(f.filter("kind = 'click'").select("eid", "sid", "t0"), f.filter("kind IN ('error', 'signup')"), ["sid"], "t0", F.col("kind"), "eid")
    return out.select("eid", "sid", "state")


SQL["radio_state_as_of"] = f"WITH {FRAMES} SELECT f.eid, f.sid, s.kind AS state FROM (SELECT * FROM frames WHERE kind = 'click') f ASOF LEFT JOIN (SELECT * FROM frames WHERE kind IN ('error', 'signup')) s ON f.sid = s.sid AND f.t0 >= s.t0"


def half_frames(spark, sf_dir):
    """Which half of a split message a frame is, counting a station's split frames."""
    f = intervals.half_parity(bridge.frames(spark, sf_dir), ["sid"], ["t0", "eid"], F.col("kind") == "purchase")
    return f.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"), F.max("eid").alias("last"))


SQL["half_frames"] = f"WITH {FRAMES}, h AS (SELECT *, CASE WHEN kind <> 'purchase' THEN 0 WHEN sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t0, eid ROWS UNBOUNDED PRECEDING) % 2 = 1 THEN 1 ELSE 2 END AS part FROM frames) SELECT sid, CAST(part AS BIGINT) AS part, count(*) AS n, max(eid) AS last FROM h GROUP BY ALL"


def continuation_kind(spark, sf_dir):
    """A frame without a kind takes its station's last known one, else data."""
    f = bridge.frames(spark, sf_dir).withColumn("known", F.when(F.col("kind") != "view", F.col("kind")))
    w = W.partitionBy("sid").orderBy("t0", "eid").rowsBetween(W.unboundedPreceding, W.currentRow)
    g = f.withColumn("as_kind", F.coalesce(F.last("known", ignorenulls=True).over(w), F.lit("data")))
    return g.groupBy("as_kind").agg(F.count(F.lit(1)).alias("frames"), F.sum("span").alias("us"))


SQL["continuation_kind"] = f"WITH {FRAMES}, g AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'view' THEN kind END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY t0, eid ROWS UNBOUNDED PRECEDING), 'data') AS as_kind FROM frames) SELECT as_kind, count(*) AS frames, CAST(sum(span) AS BIGINT) AS us FROM g GROUP BY as_kind"


def last_frames(spark, sf_dir):
    """The last twenty frames, in order."""
    return bridge.frames(spark, sf_dir).select("eid", "sid", "t0").orderBy(F.desc("t0"), F.desc("eid")).limit(20).orderBy("t0", "eid")


SQL["last_frames"] = f"WITH {FRAMES} SELECT eid, sid, t0 FROM frames ORDER BY t0 DESC, eid DESC LIMIT 20"


def radio_figures(spark, sf_dir):
    """Noise, thresholds, losses, bands and time on air of each setting in use."""
    f = bridge.frames(spark, sf_dir).select("freq", "sf", "bw", "power").distinct()
    d = F.col("power") * 100.0
    r = lambda c: F.round(c, 6)
    air = radio.time_on_air(F.col("sf"), F.col("bw"), F.lit(5), F.lit(8), F.col("power") + 10, F.lit(False), F.lit(True))
    return f.select("freq", "sf", "power", r(radio.noise_floor(F.col("bw"))).alias("noise"), radio.sensitivity(F.col("sf")).alias("snr"), radio.rejection(F.col("sf"), F.lit(9)).alias("rejection9"), r(radio.sense_threshold(F.col("bw"))).alias("sense"), r(radio.free_space_loss(F.col("freq"), d)).alias("free"), r(radio.log_distance_loss(F.col("freq"), 2.7, d)).alias("log27"), radio.band_of(F.col("freq")).alias("band"), r(radio.band_correction(F.col("freq"))).alias("correction"), r(air).alias("air_s"), r(radio.milliwatts(F.col("power"))).alias("mw"), radio.ladder_step(F.col("power")).cast("long").alias("step"))


_FSPL = "20.0 * log10(4.0 * pi() * freq / 299792458.0)"
SQL["radio_figures"] = f"""WITH {FRAMES}, f AS (SELECT DISTINCT freq, sf, bw, power FROM frames), g AS (SELECT *, pow(2.0, sf) / bw AS sym FROM f), m(sf, osf, db) AS (VALUES {_MATRIX})
SELECT freq, g.sf, power, round(-168.0 + 10.0 * log10(bw), 6) AS noise, CAST(CASE g.sf {' '.join(f'WHEN {k} THEN {v}' for k, v in radio.SENSITIVITY_DB.items())} END AS DOUBLE) AS snr, CAST(db AS DOUBLE) AS rejection9,
round(10.0 * log10(bw / 1000.0) - 102.0, 6) AS sense, round({_FSPL} + 20.0 * log10(power * 100.0), 6) AS free, round({_FSPL} + 27.0 * log10(power * 100.0), 6) AS log27,
CASE WHEN freq BETWEEN 410000000 AND 525000000 THEN '433' WHEN freq BETWEEN 850000000 AND 880000000 THEN '868' END AS band,
round(20.0 * log10(freq / CASE WHEN freq < 600000000 THEN 433920000.0 ELSE 868000000.0 END), 6) AS correction,
round((8 + 4.25) * sym + (8.0 + greatest(ceil((8.0 * (power + 10) - 4.0 * g.sf + 28.0 + 16.0) / (4.0 * (g.sf - 2 * CASE WHEN sym > 0.016 THEN 1 ELSE 0 END))) * 5, 0)) * sym, 6) AS air_s,
round(pow(10.0, power / 10.0), 6) AS mw, CAST(list_max(list_filter({radio.POWER_LADDER}, lambda p: p <= power)) AS BIGINT) AS step FROM g JOIN m ON m.sf = g.sf AND m.osf = 9"""


def audible_links(spark, sf_dir):
    """Pairs of stations that would decode each other's frames, by the made-up path loss and each sender's most common setting."""
    s = cut(common_setting(spark, sf_dir).filter(F.col("freq") == CALLING).select("power", (radio.noise_floor(F.col("bw")) + radio.sensitivity(F.col("sf"))).alias("least")))  # one row: a setting per carrier
    n = bridge.stations(spark, sf_dir).select("id")
    met = pairs.every(n.withColumnRenamed("id", "tx").crossJoin(F.broadcast(s)), n.withColumnRenamed("id", "rx")).filter("tx <> rx")
    level = (F.col("power") - (F.lit(100) + (F.col("tx") * 31 + F.col("rx") * 17) % 60)).cast("double")
    return met.filter(level >= F.col("least")).select("tx", "rx", level.alias("level"))


SQL["audible_links"] = f"WITH c AS (SELECT * FROM ({SQL['common_setting']}) WHERE freq = {CALLING}), n AS (SELECT s_suppkey AS id FROM supplier), p AS (SELECT a.id AS tx, b.id AS rx, c.sf, c.bw, CAST(c.power - (100 + (a.id * 31 + b.id * 17) % 60) AS DOUBLE) AS level FROM n a, n b, c WHERE a.id <> b.id) SELECT tx, rx, level FROM p c WHERE level >= -168.0 + 10.0 * log10(bw) + {_SENS}"


QUERIES = {name: globals()[name] for name in SQL}
