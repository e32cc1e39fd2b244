"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components are integers, floor(SCALE * x). A block of vectors is indexed by
shifting every dimension to be non-negative; a posting segment (dimension,
plane) marks the vectors whose shifted value has that bit. For a query, the
impact of a segment is its weight in that dimension times 2**plane, and segments
are processed by descending impact, quantised to powers of two: first those of
the highest level in all dimensions, then the next level. After each level the
unprocessed rest of a score lies between the sums of the negative and of the
positive impacts left, so a vector leaves as soon as its upper bound is below
the query's k-th best lower bound: that is the proof. Later levels skip the
vectors that left. When few are left, or nothing is left to process, the rest is
rescored exactly. The first TOGETHER levels, in which hardly a vector leaves, are
one step, made for some queries at a time as one product of matrices.

Queries are dealt by a hash into chunks of about CHUNK_BYTES, each broadcast by
itself; every candidate is read once per chunk and never shuffled. (Building a
block's index costs as much as some ten queries of the thousands in a chunk, so
it isn't kept between chunks.) Each task returns its k best per query, packed
into one row, and these are merged in two steps.

Scores are 64-bit integers. Bounds are kept as doubles, which are exact below
2**53; blocks and queries whose scores could exceed that are scored in whole
with integers of any size, and a score beyond 64 bits raises an OverflowError.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; shorter vectors count as padded with zeros. Ties go to smaller
vec_id. "A query's own row" is every row with its vec_id: none of these is a
candidate of the query, each is one of the others. A query row that is listed
several times asks once; different vectors under one vec_id ask for the k best of
all of theirs together. Fewer than k candidates are all returned. Rows with
a null vec_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import stored, table

SCALE, K, EVERY = 64, 20, 20
#: Bytes of the queries that are broadcast at a time.
CHUNK_BYTES = 8 << 20
#: Levels from a query's highest that are its first step, and queries that make it together.
TOGETHER, GROUP = 6, 64
#: Rescoring starts when at most this share of a block is left.
FEW = 0.02
#: Doubles, and single floats, hold integers up to here exactly.
EXACT, SINGLE = 2**53, 2**24


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null if the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    whole = F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x))
    odd = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), whole)


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class ImpactIndex:
    """Posting segments of a block: marks[s] has a 1 for each vector of segment s, which stands for 2**plane[s] in dimension[s]."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n, width = vectors.shape
        self.low, top = (vectors.min(0), vectors.max(0)) if n else (np.zeros(width, np.int64),) * 2
        self.reach = np.maximum(np.abs(self.low.astype(np.float64)), np.abs(top.astype(np.float64)))
        self.exact = bool((self.reach < EXACT).all())
        marks, dimension, plane = [], [], []
        if self.exact:
            shifted = vectors - self.low
            for d in range(width):
                for p in range(int(shifted[:, d].max(initial=0)).bit_length()):
                    marks.append((shifted[:, d] >> p & 1).astype(np.float32))
                    dimension.append(d)
                    plane.append(p)
        self.marks = np.stack(marks) if marks else np.zeros((0, n), np.float32)
        self.dimension, self.plane = np.array(dimension, np.int64), np.array(plane, np.int64)

    def whole(self, queries: np.ndarray) -> np.ndarray:
        """Which queries are scored in whole, with integers of any size."""
        return ~(4 * (np.abs(queries.astype(np.float64)) @ self.reach) < EXACT) if self.exact else np.ones(len(queries), bool)

    def impacts(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's impacts of the segments, and their levels."""
        impact = queries[:, self.dimension].astype(np.float64) * np.exp2(self.plane)
        return impact, np.frexp(np.abs(impact))[1]

    def first(self, queries: np.ndarray) -> np.ndarray:
        """What queries that aren't scored in whole know of each vector after their first step."""
        impact, level = self.impacts(queries)
        if impact.shape[1]:
            impact = np.where(level > level.max(1, keepdims=True) - TOGETHER, impact, 0.0)
        single = 4 * float((np.abs(queries.astype(np.float64)) @ self.reach).max(initial=0)) < SINGLE
        marks, impact = (self.marks, impact.astype(np.float32)) if single else (self.marks.astype(np.float64), impact)
        return (impact @ marks).astype(np.float64) + (queries @ self.low).astype(np.float64)[:, None]

    def search(self, query: np.ndarray, floor: int, k: int, own: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of this block, those in own left out, that can be among the k best, given that a score below floor can't be; and their scores. first: the query's row of first(), if it was made."""
        n = len(self.vectors)
        others = np.ones(n, bool)
        others[own] = False
        rows = np.flatnonzero(others)
        if self.whole(query[None])[0]:
            whole = self.vectors[rows].astype(object) @ query.astype(object)
            return rows, np.array([int(x) for x in whole], np.int64)
        impact, level = (x[0] for x in self.impacts(query[None]))
        order = np.argsort(-level, kind="stable")
        order = order[impact[order] != 0]
        top = level[order[:1]].max(initial=0)
        step = np.maximum(top - level[order], TOGETHER - 1)
        ends = [*(np.flatnonzero(np.diff(step)) + 1).tolist(), len(order)] if len(order) else []
        gain = float(np.maximum(impact, 0).sum())
        loss = float(np.minimum(impact, 0).sum())
        known = (self.first(query[None])[0] if first is None else first)[rows]
        at = 0
        for end in ends:
            segments = order[at:end]
            w = impact[segments]
            if at:
                known += w @ self.marks[np.ix_(segments, rows)].astype(np.float64)
            gain, loss, at = gain - float(np.maximum(w, 0).sum()), loss - float(np.minimum(w, 0).sum()), end
            bound = float(floor)
            if len(rows) > k:
                bound = max(bound, float(np.partition(known, len(rows) - k)[len(rows) - k]) + loss)
            alive = known + gain >= bound
            if not alive.all():
                rows, known = rows[alive], known[alive]
            if len(rows) <= FEW * n:
                break
        return rows, self.vectors[rows] @ query


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(queries, k: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, asked = queries.value
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(qid)
        for f in frames:
            width = max(max(map(len, f["v"]), default=0), asked.shape[1])
            vectors, ids = matrix(list(f["v"]), width), f["vec_id"].to_numpy()
            mine = np.pad(asked, ((0, 0), (0, width - asked.shape[1])))
            index, sorted_by = ImpactIndex(vectors), np.argsort(ids, kind="stable")
            lo, hi = np.searchsorted(ids[sorted_by], qid, "left"), np.searchsorted(ids[sorted_by], qid, "right")
            whole, firsts = index.whole(mine), {}
            for i in range(len(qid)):
                held = best[i]
                if i % GROUP == 0:
                    group = np.flatnonzero(~whole[i : i + GROUP])
                    firsts = dict(zip((i + group).tolist(), index.first(mine[i + group]), strict=True)) if len(group) else {}
                floor = int(held[1][-1]) if len(held[0]) == k else np.iinfo(np.int64).min
                at, scores = index.search(mine[i], floor, k, sorted_by[lo[i] : hi[i]], firsts.get(i))
                if len(at):
                    best[i] = best_of(np.concatenate([held[0], ids[at]]), np.concatenate([held[1], scores]), k)
        for a in range(0, len(qid), 4096):
            some = [i for i in range(a, min(a + 4096, len(qid))) if len(best[i][0])]
            if not some:
                continue
            yield pd.DataFrame({"query_id": [qid[i] for i in some], "ids": [best[i][0] for i in some], "scores": [best[i][1] for i in some]})

    return search


def _merged(partial: DataFrame, k: int) -> DataFrame:
    """Keeps each query's k best of the packed lists, first within 16 parts."""
    top = lambda c: F.slice(F.array_sort(F.flatten(c)), 1, k)
    hits = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("less"), x["ids"].alias("vec_id")))
    part = partial.select("query_id", (F.spark_partition_id() % 16).alias("part"), hits.alias("hits"))
    return part.groupBy("query_id", "part").agg(top(F.collect_list("hits")).alias("hits")).groupBy("query_id").agg(top(F.collect_list("hits")).alias("hits"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, embedding."""
    spark = vectors.sparkSession
    v = quantised(F.col("embedding"), scale)
    index = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").distinct()
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    chunks = -(-n * 8 * max(1, width or 0) // CHUNK_BYTES) or 1
    results = []
    for c in range(chunks):
        f = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toPandas()
        rows = matrix(list(f["v"]), max(map(len, f["v"]), default=0))
        held = spark.sparkContext.broadcast((f["vec_id"].to_numpy(), rows))
        out = _merged(index.mapInPandas(_searched(held, k), "query_id long, ids array<long>, scores array<long>"), k)
        if chunks > 1:  # one chunk's queries at a time
            out = stored(out, f"hits{c}")
            held.unpersist()
        results.append(out)
    merged = results[0]
    for out in results[1:]:
        merged = merged.unionByName(out)
    return merged.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op9_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % {EVERY} = 0) q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
