"""Near duplicates: a Jaccard self-join of documents' word shingles with Bayesian candidate pruning.

1. Each document becomes a set of 64-bit shingle fingerprints (WORDS consecutive
   words, lower-cased, between white space; shorter texts are one shingle), a
   signature of HASHES MinHash values, cut into BANDS keys. Documents with
   equal sets are one class; only one of it goes on, with the class's size.
2. Classes that share a band key meet in its bucket, with their signatures. A
   pair at the threshold misses all bands with probability
   (1 - 0.8**ROWS)**BANDS, about 5e-8. In a bucket MinHash values are compared
   STEP by STEP; a pair is dropped when the posterior probability (uniform
   prior) that its similarity reaches the threshold falls below TOLERANCE.
   Buckets return a spanning forest of the pairs that survive, so a group of n
   near copies costs n rows, and texts that merely share a passage part here.
   Buckets of more than BUCKET classes are cut into blocks that meet two by two.
3. Trees of survivors that hang together are clusters. Only their texts are
   fetched. A cluster is cut into blocks, and each pair of blocks is one group
   of rows, in which the pairs that share a band and survive are verified on
   the whole sets. A group returns each document's number of links and a
   spanning forest of them, never the pairs.
4. Counts are summed, and forests joined to classes of linked documents.

"Exact" means exact on the sets of fingerprints; two different shingles of one
pair share a 64-bit fingerprint with negligible probability. A link is lost
with probability 5e-8 (bands) plus at most TOLERANCE at each of the looks.

Defined results: texts without words (null, empty, white space) are linked to
nothing. Rows with a null doc_id are not joined: class_id and copy_id are null,
n_links 0. Rows that share a doc_id but not the text are documents of their own;
rows that repeat both are one document listed twice, and count twice as links.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import join_hot, small_batches, stored, table, tidy
from larkspan.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
#: Chance, per pair and look, that a pair which reaches the threshold is dropped.
TOLERANCE = 1e-6
#: Documents and shingles of a block; the blocks of very large components have up to MOST documents.
BLOCK, MOST, BLOCK_SHINGLES = 128, 4096, 1 << 18
#: Classes of a bucket whose signatures one task holds (twice, where two blocks meet).
BUCKET = 4096
#: Words whose fingerprints a task remembers.
CACHE = 200_000

_rng = np.random.default_rng(20)
A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
C1, C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * C1
    x = (x ^ (x >> np.uint64(33))) * C2
    return x ^ (x >> np.uint64(33))


class Shingler:
    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct fingerprints."""
        w = (text or "").lower().split()
        if not w:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            a = np.array([known[x] for x in w], np.uint64)
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for x in w:
                if x not in known:
                    known[x] = xxhash.xxh3_64_intdigest(x)
            a = np.array([known[x] for x in w], np.uint64)
        k = min(self.words, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = mixed(h + a[i : i + n])
        return np.unique(h)


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1000):
        out = np.minimum(out, _scattered(x[k : k + 1000, None] * A + B).min(0))
    return out


def _scattered(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    return x * np.uint32(0x45D9F3B)


def share_band(signatures: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which signatures agree with one in all values of some band."""
    return (signatures == one).reshape(len(signatures), BANDS, ROWS).all(2).any(1)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each multiple of STEP hashes, the fewest matches at which the posterior chance of reaching the threshold is tolerance or more."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, least = 0.0, n + 1
        # after m of n matches the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                least = m
                break
        out.append(least)
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("tid", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("signature", pa.binary())])


def _signed(words: int):
    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            out = []
            for doc_id, tid, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle(text) if doc_id is not None else np.empty(0, np.uint64)
                if len(s):
                    raw = s.tobytes()
                    key = np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, seed=1)], np.uint64).astype(np.int64).tolist()
                    out.append((doc_id, tid, *key, len(s), minhash(s).astype("<u4").tobytes()))
                else:
                    out.append((doc_id, tid, None, None, 0, None))
            cols = list(zip(*out, strict=True)) or [[]] * len(SIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SIGNED.types, strict=True)], schema=SIGNED)

    return signed


class Forest:
    """Union-find over doc_ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def alike(sizes: np.ndarray, signatures: np.ndarray, a: int, other: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """Those of other whose size fits a's and whose posterior chance of reaching the threshold stays at the tolerance or above."""
    small, large = np.minimum(sizes[a], sizes[other]), np.maximum(sizes[a], sizes[other])
    other = other[small >= threshold * large - 1e-9]
    matches = np.zeros(len(other), np.int64)
    for k, need in enumerate(least):
        if not len(other):
            break
        at = slice(k * STEP, (k + 1) * STEP)
        matches += (signatures[other, at] == signatures[a, at]).sum(1)
        live = matches >= need
        other, matches = other[live], matches[live]
    return other


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of a row in left and a larger one in right, those that share a band key, survive pruning and reach the threshold exactly."""
    signatures = np.stack([minhash(s) for s in sets])
    least = least_matches(threshold, tolerance)
    sizes = np.array([len(s) for s in sets])
    found = []
    for a in left.tolist():
        other = right[right > a] if len(left) == len(right) and (left == right).all() else right
        other = alike(sizes, signatures, a, other[share_band(signatures[other], signatures[a])], threshold, least)
        if len(other):
            found.append((a, other))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.concatenate([np.full(len(o), a) for a, o in found])
    y = np.concatenate([o for _, o in found])
    both = intersections(sets, x, y)
    real = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
    return x[real], y[real]


def surviving_forest(sizes: np.ndarray, signatures: np.ndarray, side: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that survive pruning, between the two sides (0 and 1) or, if there is one side only, within it. Rows that already share a tree aren't compared."""
    least, tree, out = least_matches(threshold, tolerance), np.arange(len(sizes)), []
    two = 0 < int(side.sum()) < len(side)
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    for k, a in enumerate(order.tolist()):
        # a row meets the larger ones that the length filter allows
        other = order[k + 1 : np.searchsorted(ranked, ranked[k] / threshold + 1e-9, "right")]
        other = other[tree[other] != tree[a]]
        if two:
            other = other[side[other] != side[a]]
        for b in alike(sizes, signatures, a, other, threshold, least).tolist():
            if tree[b] != tree[a]:
                out.append((a, b))
                tree[tree == tree[b]] = tree[a]
    return out


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the pairs' intersections."""
    rows = np.unique(np.concatenate([x, y]))
    if len(x) <= 3 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    # many pairs of few sets: products of 0/1 matrices, some columns at a time
    place = np.full(len(sets), -1)
    place[rows] = np.arange(len(rows))
    items = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, count = np.unique(items, return_inverse=True, return_counts=True)
    shared = count > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    both = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(1, (1 << 22) // len(rows))
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        part = np.zeros((len(rows), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        both += part @ part.T
    return np.rint(both[place[x], place[y]]).astype(np.int64)


def _grouped(batches: Iterable[pa.RecordBatch], width: int, work, names: list[str]) -> Iterator[pa.RecordBatch]:
    """work() on each run of rows whose first width values agree; its rows of numbers are passed on in batches."""
    held: list[tuple] = []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and r[:width] != held[0][:width]:
                out += work(held)
                held = []
            held.append(r)
        if len(out) > 10_000:
            yield batch()
            out = []
    if held:
        out += work(held)
    yield batch()


def _pruned(threshold: float, tolerance: float):
    """Rows (band, i, j, block, cid, n, signature) sorted by (band, i, j) to edges (a, b)."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        rows = list({r[4]: r for r in rows}.values())
        ids, sizes = [r[4] for r in rows], np.array([r[5] for r in rows], np.int64)
        signatures = np.frombuffer(b"".join([r[6] for r in rows]), "<u4").reshape(len(rows), HASHES)
        side = np.array([r[3] != r[1] for r in rows])
        if rows[0][1] != rows[0][2] and not 0 < side.sum() < len(side):
            return
        for a, b in surviving_forest(sizes, signatures, side, threshold, tolerance):
            yield ids[a], ids[b]

    return lambda batches: _grouped(batches, 3, work, ["a", "b"])


def _judged(words: int, threshold: float, tolerance: float):
    """Rows (comp, i, j, block, cid, weight, text) sorted by (comp, i, j) to rows (cid, links, other): links of a class, or other set for an edge."""
    shingle = Shingler(words)

    def work(rows: list[tuple]) -> Iterator[tuple]:
        i, j = rows[0][1], rows[0][2]
        rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
        ids, weights = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        blocks = np.array([r[3] for r in rows])
        every = np.arange(len(rows))
        left, right = (every, every) if i == j else (every[blocks == i], every[blocks == j])
        if len(rows) < 2 or not len(left) or not len(right):
            return
        x, y = linked_pairs([shingle(r[6]) for r in rows], left, right, threshold, tolerance)
        links = np.bincount(x, weights[y], len(rows)) + np.bincount(y, weights[x], len(rows))
        for k in np.flatnonzero(links).tolist():
            yield int(ids[k]), int(links[k]), None
        forest = Forest()
        for a, b in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
            if forest.join(a, b):
                yield a, 0, b

    return lambda batches: _grouped(batches, 3, work, ["cid", "links", "other"])


def _two_by_two(blocked: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with key, blocks and block, copied to each pair (i, j) of blocks that theirs is part of; grouped and sorted by key, i, j."""
    dealt = blocked.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(key, F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"), "block", *columns)
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def candidate_clusters(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket: int = BUCKET) -> DataFrame:
    """node, comp: classes (cid, n, signature) that pairs which survive pruning connect."""
    band = lambda b: F.xxhash64(b, F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS))
    keys = classes.select("cid", F.explode(F.array(*[band(F.lit(b)) for b in range(BANDS)])).alias("band"))
    shared = stored(keys.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    held = join_hot(keys, shared, ["band"], "m").join(classes.select("cid", "n", "signature"), "cid")
    blocks = F.ceil(F.col("m") / bucket).cast("int")
    held = held.select("band", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), "cid", "n", "signature")
    edges = _two_by_two(held, "band", "cid", "n", "signature").mapInArrow(tidy("ngram_jaccard", _pruned(threshold, tolerance)), "a long, b long")
    return components(edges)


def _linked(docs: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """One row per input row: doc_id, tid (digest of the text), class_id, copy_id, n_links, n_shingles, stays (whether the row is the one of its class that has the smallest doc_id, then tid)."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    signed = stored(text.mapInArrow(tidy("ngram_jaccard", _signed(words)), "doc_id long, tid string, k1 long, k2 long, n int, signature binary"), "signed")
    # every row of a class has the same n and signature
    grouped = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tid")).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "signature")])
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    comps = stored(candidate_clusters(classes, threshold, tolerance), "clusters")
    members = comps.select(F.col("node").alias("cid"), "comp").join(classes.select("cid", "first", "copies", "n"), "cid")
    totals = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    by_docs = F.ceil(F.col("size") / F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.floor(F.col("size") / 32))))
    totals = totals.select("comp", F.greatest(by_docs, F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(totals, "comp").select("comp", "cid", "first.doc_id", "first.tid", F.col("copies").alias("weight"), "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"))
    groups = _two_by_two(text.join(members, ["doc_id", "tid"]), "comp", "cid", "weight", "text")
    judged = stored(groups.mapInArrow(tidy("ngram_jaccard", _judged(words, threshold, tolerance)), "cid long, links long, other long"), "judged")
    links = judged.filter("other IS NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    trees = components(judged.filter("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
    firsts = trees.join(classes.select("cid", "first"), "cid").groupBy("comp").agg(F.min("first").alias("least"))
    named = classes.select("cid", "k1", "k2", "first", "copies").join(trees.join(firsts, "comp"), "cid", "left").join(links, "cid", "left")
    named = named.select("k1", "k2", "copies", F.col("first.doc_id").alias("copy_id"), F.coalesce("least", "first").alias("least"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = signed.select("doc_id", "tid", "k1", "k2", F.col("n").cast("long").alias("n_shingles"))
    some = join_hot(rows.filter("n_shingles > 0"), stored(named, "named"), ["k1", "k2"], "copies")
    stays = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("tid") == F.col("least.tid"))
    some = some.select("doc_id", "tid", F.col("least.doc_id").alias("class_id"), "copy_id", F.col("n_links").cast("long").alias("n_links"), "n_shingles", stays.alias("stays"))
    none = rows.filter("n_shingles = 0").select("doc_id", "tid", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles", F.lit(True).alias("stays"))
    return some.unionByName(none)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of the documents linked directly or through others), copy_id (smallest doc_id with the same shingles), n_links (other documents whose similarity reaches the threshold), n_shingles."""
    return _linked(docs, words, threshold, tolerance).select("doc_id", "class_id", "copy_id", "n_links", "n_shingles")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs, all columns, with one document of each class of linked documents: the smallest doc_id (and of its texts the one with the smallest digest)."""
    gone = _linked(docs, words, threshold, tolerance).filter(~F.col("stays")).select(F.col("doc_id").alias("__larkspan_gone"), F.col("tid").alias("__larkspan_tid")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("__larkspan_gone")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__larkspan_tid"))
    return docs.join(gone, same, "left_anti")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
