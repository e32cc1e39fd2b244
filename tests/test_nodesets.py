"""Node sets, unique names and numbers."""

import random

import pytest

from larkspan.operators import names
from larkspan.sources import nodesets

FOUR = """
nodes:
  n01: {id: 1, lat: 52.5, lon: 13.4, height_m: 12, height_from: roof, max_dbm: 27, antenna: {type: yagi, azimuth_deg: 90}, tags: [transport, transport, a]}
  n02: {id: 2, lat: 52.51, lon: 13.41}
offsets:
  - {between: [n01, n02], db: 3.5, note: wall}
"""


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/four.yaml"
    with open(path, "w") as f:
        f.write(FOUR)
    nodes, offsets = nodesets.read_nodeset(spark, path)
    rows = {r.name: r for r in nodes.collect()}
    assert (rows["n01"].id, rows["n01"].max_dbm, rows["n01"].antenna.type, list(rows["n01"].tags)) == (1, 27.0, "yagi", ["transport", "a"])
    assert (rows["n02"].height_m, rows["n02"].height_from, rows["n02"].max_dbm) == (2.0, "assumed", None)
    assert [tuple(r) for r in offsets.collect()] == [("n01", "n02", 3.5, "wall")]
    nodesets.write_nodeset(nodes, offsets, f"{tmp_path}/again.yaml")
    again, back = nodesets.read_nodeset(spark, f"{tmp_path}/again.yaml")
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect())) and back.collect() == offsets.collect()
    assert nodesets.geometry_key(nodes) == nodesets.geometry_key(again) and len(nodesets.geometry_key(nodes)) == 16


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("nodes: {a: {id: 1, lat: 1, lon: 1}, b: {id: 1, lat: 1, lon: 1}}", "share id 1"),
        ("nodes: {a: {id: 1, lat: 1}}", "needs id, lat and lon"),
        ("nodes: {A_b: {id: 1, lat: 1, lon: 1}}", "no name"),
        ("nodes: {a: {id: 1001, lat: 1, lon: 1}}", "an id is 1 to"),
        ("nodes: {a: {id: 1, lat: 1, lon: 1, max_dbm: 40}}", "max_dbm is -9 to 27"),
        ("nodes: {a: {id: 1, lat: 1, lon: 1, height_from: guess}}", "height_from"),
        ("nodes: {a: {id: 1, lat: 1, lon: 1, board: x}}", "board"),
        ("nodes: {a: {id: 1, lat: 1, lon: 1}}\noffsets: [{between: [a, z], db: 1}]", "names z"),
        ("[1]", "not a node set"),
        ("nodes: {a: [", "x.yaml"),
    ],
)
def test_errors_name_the_place(text, part):
    with pytest.raises(ValueError, match="x.yaml") as e:
        nodesets.parsed(text, "x.yaml")
    assert part in str(e.value)


def test_unique_names_against_a_fold(spark):
    rng = random.Random(5)
    bases = [rng.choice(["a", "a-2", "a-2-2", "site", "site-3", "x" * 40, "x" * 31 + "-y", "x" * 30 + "-2", "n-1-", "", "b" * 32, "b" * 29]) for _ in range(600)]
    taken, want = set(), []
    for b in bases:
        name, k = b[:32].rstrip("-"), 2
        while name in taken:
            tail = f"-{k}"
            name, k = b[: 32 - len(tail)].rstrip("-") + tail, k + 1
        taken.add(name)
        want.append(name)
    df = spark.createDataFrame(list(enumerate(bases)), "i long, base string").repartition(5)
    got = [r.name for r in sorted(names.unique_names(df, "base", "i").collect(), key=lambda r: r.i)]
    assert got == want


def test_free_numbers(spark):
    taken = [1, 2, 3, 5, 9, 10, 10, 12, -4]
    df = spark.createDataFrame([(i,) for i in range(8)], "i long")
    got = [r.id for r in sorted(names.free_numbers(df, "i", spark.createDataFrame([(t,) for t in taken], "id long")).collect(), key=lambda r: r.i)]
    assert got == [4, 6, 7, 8, 11, 13, 14, 15]
