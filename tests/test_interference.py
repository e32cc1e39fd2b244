"""Running sums along time against pairs of frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import radio
from larkspan.operators import interference, intervals
from larkspan.plans import reports


def level(power, sid, rx):
    return (power - 90 - np.fmod(sid * 7 + rx * 3, 20)).astype(np.float64)


def brute(frames, heard, width):
    """(eid, rx) -> talked, swamped, from every pair and every piece."""
    out = {}
    for eid, sid, t0, t1, freq, bw, sf, power in frames:
        for rx in heard.get(eid, ()):
            others = [o for o in frames if o[0] != eid and t0 < o[3] and o[2] < t1 and freq is not None and o[4] is not None and abs(freq - o[4]) < (bw + o[5]) / 2]
            talked = any(o[1] == rx for o in others)
            cuts = sorted({t0, t1} | {e for o in others for e in o[2:4] if t0 < e < t1})
            swamped = False
            for lo, hi in zip(cuts, cuts[1:]):
                for osf in range(7, 13):
                    mw = sum(10 ** ((o[7] - 90 - (o[1] * 7 + rx * 3) % 20) / 10) for o in others if o[6] == osf and o[2] < hi and o[3] > lo)
                    if mw and round(power - 90 - (sid * 7 + rx * 3) % 20 - 10 * math.log10(mw), 6) < radio.INTER_SF_DB[sf - 7][osf - 7]:
                        swamped = True
            if sid != rx and (talked or swamped):
                out[eid, rx] = talked, swamped
    return out


@pytest.mark.parametrize("spread", [4000, 60])
def test_sums_against_pairs(spark, spread):
    """Crowded and sparse air; frames of no length, over several slices and at edges of them; channels that overlap partly."""
    rng, width = random.Random(spread), 50
    frames = []
    for i in range(150):
        t0 = rng.randrange(-40, spread) // 5 * 5
        frames.append((i, rng.randrange(12), t0, t0 + rng.choice([-5, 0, 5, 10, 30, 50, 140]), rng.choice([1000, 1100, 1130, None]), rng.choice([125, 250]), rng.randrange(7, 13), rng.randrange(2, 30)))
    heard = {i: {rng.randrange(12), rng.randrange(12)} for i in range(140)}
    df = spark.createDataFrame(frames, "eid long, sid long, t0 long, t1 long, freq long, bw long, sf long, power long")
    rx = spark.createDataFrame([(i, r) for i, rs in heard.items() for r in rs], "eid long, rx long")
    got = interference.judged(df, rx, width, level, reports._beaten, lambda fa, ba, fb, bb: F.abs(fa - fb) < (ba + bb) / 2).collect()
    want = brute(frames, heard, width)
    assert {(r.eid, r.rx): r.talked for r in got} == {k: v[0] for k, v in want.items()}
    # what is talked over isn't summed any more
    assert all(r.swamped == want[r.eid, r.rx][1] for r in got if not r.talked)
    assert any(v == (False, True) for v in want.values())


def test_ranges_in_parts(monkeypatch):
    monkeypatch.setattr(interference, "CELLS", 7)
    n = np.array([0, 0, 1, 2, 3, 3, 20])
    first = np.array([5, 0, 9, 4, 1, 2, 0])
    got = [[at[k][real[k]].tolist() for k in range(len(at))] for _, at, real in interference._running(first, first + n)]
    assert sum(got, []) == [list(range(a, a + k)) for a, k in zip(first, n)] and len(got) > 3


def test_verdicts_make_no_pairs(spark, monkeypatch):
    """Pairs of frames, which grow with the square of what is on at a time, aren't rows of the verdicts' plan."""

    def refused(*_, **__):
        raise AssertionError("pairs")

    monkeypatch.setattr(intervals, "overlaps", refused)
    monkeypatch.setattr(intervals, "pieces", refused)
    assert reports.reception_verdicts(spark, "/root/testdata/sf0.001").count() == 2000
