"""The reception automaton against a plain simulation, and hand cases."""

import random

from pyspark.sql import functions as F

from larkspan.operators import medium

NOISE = {7: -7.5, 8: -10.0, 9: -12.5, 10: -15.0, 11: -17.5, 12: -20.0}


def simulated(arrivals, states, sent, pairwise):
    """Instant by instant: states, then own frames, then frames that arrive."""
    out, locks, until, now = {}, {}, {}, {}
    slots = {(s["rx"], s["slot"]) for s in states}
    rows = [(s["t"], 0, s["n"], s) for s in states] + [(o["t0"], 1, 0, o) for o in sent] + [(a["t0"], 2, a["eid"], a) for a in arrivals]
    for t, kind, _, x in sorted(rows, key=lambda r: r[:3]):
        if kind == 1:
            until[x["rx"]] = x["t1"]
            for k in slots:
                if k[0] == x["rx"]:
                    locks.pop(k, None)
            continue
        k = (x["rx"], x["slot"])
        if kind == 0:
            now[k] = x
            if x["mode"] != "RX":
                locks.pop(k, None)
            continue
        st = now.get(k)
        if st is None or st["mode"] not in ("RX", "CAD") or (k in slots and until.get(x["rx"], t) > t):
            continue
        level = round(x["level"]) if pairwise else x["level"]
        me = (x["eid"], *k)
        out[me] = (None, None)
        if any(st[c] != x[c] for c in ("bw", "sf", "sync")) or abs(st["freq"] - x["freq"]) > x["bw"] / 4 or level < -117.0309 + NOISE[x["sf"]]:
            continue
        if st["mode"] == "CAD":
            out[me] = ("energy", None)
            continue
        held = locks.get(k)
        if held is not None and held[1] <= t:
            held = None
        if held is not None and level - held[2] < 6:
            out[me] = ("energy", True)
            continue
        if held is not None:
            out[held[0]] = ("frame", True)
        locks[k] = (me, x["t1"], level)
        out[me] = ("frame", False)
    return out


def test_slots_against_a_simulation(spark):
    rng = random.Random(8)
    for pairwise in (False, True):
        arrivals = [{"eid": i, "rx": rng.randrange(3), "slot": rng.randrange(2), "t0": rng.randrange(400), "freq": rng.choice([868_000_000, 868_020_000, 868_100_000]), "bw": 125_000, "sf": rng.choice([7, 7, 9]), "sync": 18, "level": rng.choice([-100.0, -104.5, -107.25, -120.0, -140.0])} for i in range(1500)]
        for a in arrivals:
            a["t1"] = a["t0"] + rng.randrange(1, 30)
        states = [{"rx": rng.randrange(3), "slot": rng.randrange(2), "t": rng.randrange(400), "n": i, "mode": rng.choice(["RX", "RX", "CAD", "SLEEP"]), "freq": 868_000_000, "bw": 125_000, "sf": rng.choice([7, 9]), "sync": 18} for i in range(200)]
        sent = [{"rx": rng.randrange(3), "t0": t, "t1": t + rng.randrange(1, 10)} for t in range(0, 400, 20)]
        a, s, o = (spark.createDataFrame(x, k) for x, k in ((arrivals, "eid long, rx long, slot int, t0 long, t1 long, freq long, bw long, sf long, sync long, level double"), (states, "rx long, slot int, t long, n long, mode string, freq long, bw long, sf long, sync long"), (sent, "rx long, t0 long, t1 long")))
        got = {(r.eid, r.rx, r.slot): (r.starts, r.lost) for r in medium.heard(a, s, o, pairwise).collect()}
        assert got == simulated(arrivals, states, sent, pairwise)


def test_hand_cases(spark):
    kinds = "eid long, rx long, slot int, t0 long, t1 long, freq long, bw long, sf long, sync long, level double"
    frame = lambda eid, t0, level: (eid, 2, 0, t0, t0 + 300_000, 869_525_000, 125_000, 9, 18, level)
    states = spark.createDataFrame([(2, 0, 0, 0, "RX", 869_525_000, 125_000, 9, 18)], "rx long, slot int, t long, n long, mode string, freq long, bw long, sf long, sync long")
    none = spark.createDataFrame([], "rx long, t0 long, t1 long")
    loud = medium.heard(spark.createDataFrame([frame(1, 1000, -113.0), frame(2, 31_000, -106.0)], kinds), states, none)
    assert {r.eid: (r.starts, r.lost) for r in loud.collect()} == {1: ("frame", True), 2: ("frame", False)}
    quiet = medium.heard(spark.createDataFrame([frame(1, 1000, -113.0), frame(2, 31_000, -108.0)], kinds), states, none)
    assert {r.eid: (r.starts, r.lost) for r in quiet.collect()} == {1: ("frame", False), 2: ("energy", True)}
    later = medium.heard(spark.createDataFrame([frame(1, 1000, -113.0), frame(2, 301_000, -113.0)], kinds), states, none)
    assert {r.lost for r in later.collect()} == {False}
    assert medium.heard(spark.createDataFrame([], kinds), states, none).select(F.count("*")).first()[0] == 0
