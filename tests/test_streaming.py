"""Streams drained to their end against the same figures in batch."""

import uuid

import pytest
from pyspark.sql import functions as F

from larkspan.streaming import rolling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def drained(spark, events, transform, mode="complete"):
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    name = f"t_{uuid.uuid4().hex}"
    query = transform(rolling.frames(stream)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


@pytest.mark.parametrize("transform", [rolling.airtime, rolling.sliding_airtime, rolling.sessions])
def test_windows(spark, events, transform):
    batch = sorted(tuple(r) for r in transform(rolling.frames(events)).collect())
    assert drained(spark, events, transform) == batch and batch


def test_once(spark, events):
    twice = drained(spark, events, lambda f: rolling.once(f.unionByName(f)).select("eid"), "append")
    assert len(twice) == len(set(twice)) == events.count()


def test_running_totals(spark, events):
    got = {}
    for sid, us, n in drained(spark, events, rolling.running_totals, "update"):
        got[sid] = max(got.get(sid, (0, 0)), (us, n))
    f = rolling.frames(events).groupBy("sid").agg(F.sum("span").alias("us"), F.count(F.lit(1)).alias("n"))
    assert got == {r.sid: (r.us, r.n) for r in f.collect()}
