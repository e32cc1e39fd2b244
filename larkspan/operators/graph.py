"""Graph operators over undirected links (a, b), both directions listed: hops, diameter, components, coverage."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.storage import cut


def both_ways(links: DataFrame) -> DataFrame:
    """Links whose reverse is listed too."""
    return links.select("a", "b").distinct().join(links.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), ["a", "b"], "left_semi")


class _Links:
    """Links as arrays: the nodes, sorted, and each one's neighbours, as places among them. passes tells which nodes pass a message on."""

    def __init__(self, links: DataFrame, via: DataFrame | None) -> None:
        ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct().toArrow()
        a, b = (ends.column(c).to_numpy() for c in ("a", "b"))
        self.nodes = np.unique(np.concatenate([a, b]))
        to, of = np.searchsorted(self.nodes, b), np.searchsorted(self.nodes, a)
        order = np.argsort(to, kind="stable")
        self.of = of[order].astype(np.int32)  # who reaches a node, the nodes in order
        self.reached, self.starts = np.unique(to[order], return_index=True)
        self.passes = None if via is None else np.isin(self.nodes, via.select(F.col("node").cast("long").alias("node")).filter("node IS NOT NULL").distinct().toArrow().column("node").to_numpy())

    def steps(self, at: np.ndarray, most: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """For up to 64 sources by their places: each number of hops with a word per node, whose bit i is set if source i first reaches it by so many."""
        seen = np.zeros(len(self.nodes), np.uint64)
        seen[at] |= np.uint64(1) << np.arange(len(at), dtype=np.uint64)
        front = seen.copy()
        for d in itertools.count():
            yield d, front
            if d == most or not len(self.of):
                return
            passing = front if self.passes is None or d == 0 else np.where(self.passes, front, np.uint64(0))
            front = np.zeros(len(self.nodes), np.uint64)
            front[self.reached] = np.bitwise_or.reduceat(passing[self.of], self.starts)
            front &= ~seen
            seen |= front
            if not front.any():
                return


def _by_block(links: DataFrame, sources: DataFrame, via: DataFrame | None, schema: str, rows: Callable[[_Links, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """rows(links, sources) of blocks of 64 distinct sources. The links go to each executor as arrays of a few bytes a link, where the answer has a row per pair of nodes."""
    spark = sources.sparkSession
    held = spark.sparkContext.broadcast(_Links(links, via))
    src = cut(sources.select(F.col("src").cast("long").alias("src")).filter("src IS NOT NULL").distinct())

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(found), 64):
                yield from rows(held.value, found[lo : lo + 64])

    return src.repartition(max(1, -(-src.count() // TASK_SOURCES))).mapInArrow(walk, schema)


def _apart(links: _Links, src: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sources with links, their places, and the sources without any."""
    at = np.searchsorted(links.nodes, src)
    known = np.isin(src, links.nodes)
    return src[known], at[known], src[~known]


#: Sources of a task, and nodes whose rows are made at a time.
TASK_SOURCES, AT_ONCE = 256, 16_384


def _lists(most: int | None):
    def rows(links: _Links, src: np.ndarray) -> Iterator[pa.RecordBatch]:
        src, at, alone = _apart(links, src)
        names = ["src", "d", "nodes"]
        if len(alone):
            yield pa.RecordBatch.from_arrays([pa.array(alone), pa.array(np.zeros(len(alone), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(alone) + 1, dtype=np.int32)), pa.array(alone))], names=names)
        for d, front in links.steps(at, most) if len(src) else ():
            new = np.flatnonzero(front)
            for lo in range(0, len(new), AT_ONCE):
                part = new[lo : lo + AT_ONCE]
                bits = np.unpackbits(front[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=len(src))
                who, which = np.nonzero(np.ascontiguousarray(bits.T))
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(src)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(np.full(len(src), d, np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(links.nodes[part[which]]))], names=names)

    return rows


def hops(links: DataFrame, sources: DataFrame, via: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """src, node, d: the fewest hops from each source (src), itself included at 0; with most, ways of up to so many only.

    With via (node), only those pass a message on; a source always does. A task
    walks the links for 64 sources at a time, one bit each, and nothing is written.
    """
    found = _by_block(links, sources, via, "src long, d long, nodes array<long>", _lists(most))
    zero = F.lit(0).cast("long")
    return found.select("src", F.explode("nodes").alias("node"), "d").unionByName(_unknown(sources).select("src", F.col("src").alias("node"), zero.alias("d")))


def _unknown(sources: DataFrame) -> DataFrame:
    """The source without a number, if there is one: it reaches itself."""
    return sources.select(F.col("src").cast("long").alias("src")).filter("src IS NULL").distinct()


def _counts(most: int | None):
    def rows(links: _Links, src: np.ndarray) -> Iterator[pa.RecordBatch]:
        src, at, alone = _apart(links, src)
        n = [(0, len(alone))] if len(alone) else []
        n += [(d, int(np.bitwise_count(front).sum())) for d, front in links.steps(at, most)] if len(src) else []
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in n], pa.int64()), pa.array([k for _, k in n], pa.int64())], names=["d", "n"])

    return rows


def diameter(links: DataFrame, sources: DataFrame, nodes: int, most: int | None = None) -> DataFrame:
    """diameter, unreached: over all ordered pairs of nodes, given as sources too; only how many pairs lie so many hops apart is made."""
    found = _by_block(links, sources, None, "d long, n long", _counts(most)).filter("n > 0").unionByName(_unknown(sources).select(F.lit(0).cast("long").alias("d"), F.lit(1).cast("long").alias("n")))
    return found.agg(F.max("d").alias("diameter"), (F.lit(nodes * nodes).cast("long") - F.coalesce(F.sum("n"), F.lit(0))).alias("unreached"))


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u, v), v < u: every neighbour above a node goes to the least of the neighbourhood, then every one below it. Keeps components, and roughly halves their depth."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    above = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = above.groupBy("u").agg(F.min("v").alias("m"))
    below = above.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(low.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component); isolated nodes are their own, links to what isn't a node don't count.

    Alternating stars until every component is one: rounds grow with the
    logarithm of the nodes, not with the length of chains.
    """
    known = cut(nodes.select("node").distinct())
    held = links.join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi")
    edges = cut(held.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        edges = cut(_stars(edges))
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        if ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 OR (c = 1 AND r = 1)").isEmpty():
            break
    return known.join(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def greedy_coverage(covers: DataFrame, weights: DataFrame, picks: int, k: int = 1, seed: DataFrame | None = None) -> DataFrame:
    """step, cand, gain: repeatedly the candidate (cand, item) that adds most weight (item, w) to items covered fewer than k times.

    Ties go to the smaller candidate; it stops where nothing is gained. What
    covers what is written once. Each step is one join and one aggregate; the driver sees one row of it.
    """
    spark = covers.sparkSession
    held = weights.select("item", "w", F.lit(0).cast("long").alias("n"))
    if seed is not None:
        have = seed.groupBy("item").agg(F.count(F.lit(1)).alias("s"))
        held = held.join(have, "item", "left").select("item", "w", F.coalesce("s", F.lit(0)).cast("long").alias("n"))
    covers, held, out, taken = cut(covers.select("cand", "item")), cut(held), [], []
    for step in range(picks):
        open_items = held.filter(F.col("n") < k)
        left = covers.filter(~F.col("cand").isin(taken)) if taken else covers
        top = left.join(open_items, "item").groupBy("cand").agg(F.sum("w").alias("gain")).orderBy(F.desc("gain"), "cand").first()
        if top is None or top["gain"] <= 0:
            break
        out.append((step, top["cand"], top["gain"]))
        taken.append(top["cand"])
        mine = covers.filter(F.col("cand") == top["cand"]).select("item", F.lit(1).alias("one")).distinct()
        held = cut(held.join(mine, "item", "left").select("item", "w", (F.col("n") + F.coalesce("one", F.lit(0))).cast("long").alias("n")))
    return spark.createDataFrame(out, "step long, cand long, gain double" if out and isinstance(out[0][2], float) else "step long, cand long, gain long")


def improve_by_swaps(covers: DataFrame, weights: DataFrame, chosen: list[int], k: int = 1, rounds: int = 20) -> tuple[list[int], float]:
    """Swaps a chosen candidate for another one as long as that raises the covered weight; the best swap first, ties to smaller candidates.

    Returns the candidates, in their places, and the weight. A round is one
    distributed evaluation: what removal loses, what insertion gains, and what
    both share; only the best swap comes to the driver.
    """
    chosen = list(chosen)
    for _ in range(rounds):
        counts = covers.filter(F.col("cand").isin(chosen)).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        held = cut(covers.join(weights, "item").join(counts, "item", "left").select("cand", "item", "w", F.coalesce("n", F.lit(0)).alias("n")))
        inside = F.col("cand").isin(chosen)
        loss = held.filter(inside & (F.col("n") <= k)).groupBy(F.col("cand").alias("out")).agg(F.sum("w").alias("loss"))
        gain = held.filter(~inside & (F.col("n") < k)).groupBy(F.col("cand").alias("into")).agg(F.sum("w").alias("gain"))
        # an item at exactly k that both cover is lost by the removal and won back by the insertion
        edge = held.filter(F.col("n") == k)
        both = edge.filter(inside).select(F.col("cand").alias("out"), "item", "w").join(edge.filter(~inside).select(F.col("cand").alias("into"), "item"), "item").groupBy("out", "into").agg(F.sum("w").alias("back"))
        everyone = covers.select("cand").distinct()
        outs = everyone.filter(inside).select(F.col("cand").alias("out")).join(loss, "out", "left").withColumn("one", F.lit(1))
        intos = everyone.filter(~inside).select(F.col("cand").alias("into")).join(gain, "into", "left").withColumn("one", F.lit(1))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        swaps = outs.join(intos, "one").join(both, ["out", "into"], "left").select("out", "into", (zero("gain") - zero("loss") + zero("back")).alias("delta"))
        best = swaps.orderBy(F.desc("delta"), "out", "into").first()
        if best is None or best["delta"] <= 1e-9:
            break
        chosen[chosen.index(best["out"])] = best["into"]
    covered = covers.filter(F.col("cand").isin(chosen)).groupBy("item").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n")).join(weights, "item")
    return chosen, covered.agg(F.sum(F.col("w") * F.col("n"))).first()[0] or 0


def relayed_hops(links: DataFrame, pairs: DataFrame, forwarders: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst, d of each pair: the fewest hops, up to most if given, through forwarders only. Unlike hops(), a pair of one node counts the shortest way round; pairs without a way are left out."""
    front = cut(pairs.select("src").distinct().select("src", F.col("src").alias("node")))
    passed, hits = front, []
    for k in itertools.count(1):
        near = cut(front.join(links.select(F.col("a").alias("node"), F.col("b").alias("to")), "node").select("src", F.col("to").alias("node")).distinct())
        hits.append(near.withColumn("d", F.lit(k).cast("long")))
        if k == most:
            break
        front = cut(near.join(forwarders.select("node").distinct(), "node", "left_semi").select("src", "node").join(passed, ["src", "node"], "left_anti"))
        if front.isEmpty():
            break
        passed = passed.unionByName(front)
        passed = cut(passed) if k % 8 == 0 else passed
    wanted = pairs.select("src", "dst").distinct()
    return functools.reduce(DataFrame.unionByName, hits).withColumnRenamed("node", "dst").join(wanted, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("d").alias("d"))
