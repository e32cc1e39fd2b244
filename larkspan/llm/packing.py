"""Packing of token sequences by minimum bin slack.

Documents are tokenized on the executors and cut into pieces; what is then known
of a piece is a few numbers. Packing only needs the histogram of lengths, which
has CAPACITY entries at most: per bin, the longest piece left is taken, a bitset
subset-sum program over the available lengths finds the fullest combination
that fits beside it, and the combination is removed - as often as the histogram
holds it, since the next bin would choose it again. The resulting patterns
are handed to the executors, and a piece finds its place from its rank among the
pieces of its length. Nothing is sorted for that: while pieces are written, each
task numbers those of a length as they come, and the counts of the tasks before
are added. So a length which a third of all pieces have (full pieces, a group of
copies) is spread over as many tasks as wrote them.

Defined results: a null text counts as empty, and a document always ends with
END, so it has a piece of one token at least. Every input row is packed, rows
that repeat a doc_id too. Pieces longer than CAPACITY don't occur.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspan.llm._common import remembers, small_batches, stored, table, tidy

CAPACITY = 2048
END = 0
#: Chunks of text whose ids a worker remembers; some 150 bytes each.
CACHE = 500_000
#: Marks that never join a run of letters. The apostrophe does: the file's pattern knows endings like 's.
MARKS = ".,;:!?()[]{}*#%&$+-/|=<>\"_~^@"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Ids of texts by the tokenizer file, as little-endian 32-bit words.

    The file's pattern never matches across white space, so a text's ids are
    those of its chunks between spaces and line feeds. Chunks are encoded once
    and looked up from then on. The file lower-cases by character, so chunks are
    looked up lower-cased, but for texts where that could differ (a capital
    sigma, whose small form depends on its place) or could make up a special
    token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def learn(self, fresh: list[str]) -> None:
        """Remembers the ids of chunks. A chunk of letters and ASCII marks after them has the ids of both; letters alone are encoded many at a time and told apart by their ends."""
        known, marks, letters, other = self.known, {}, set(), []
        for c in fresh:
            head = c.rstrip(MARKS)
            if head.isalpha() and len(head) < 200:
                if len(head) < len(c):
                    tail = c[len(head) :]
                    marks[c] = (head, tail)
                    if tail not in known:
                        other.append(tail)
                if head not in known:
                    letters.add(head)
            else:
                other.append(c)
        encode = lambda parts: self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        words = list(letters)
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            ids = np.array(encode([" ".join(part)])[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * at).tolist()]
                known.update(zip(part, [raw[x:y] for x, y in zip(at, at[1:], strict=False)], strict=True))
            else:
                other += part
        for a in range(0, len(other), 1000):
            part = other[a : a + 1000]
            known.update(zip(part, (array("I", e.ids).tobytes() for e in encode(part)), strict=True))
        for c, (head, tail) in marks.items():
            known[c] = known[head] + known[tail]

    @staticmethod
    def chunks(text: str) -> list[str]:
        if "<|" not in text and "\u03a3" not in text:
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, out, late = self.known.get, [], []
        for k, text in enumerate(texts):
            found = list(map(get, chunks := self.chunks(text)))
            try:
                out.append(b"".join(found))
            except TypeError:  # some are unknown
                late.append((k, found, [(i, chunks[i]) for i, x in enumerate(found) if x is None]))
                out.append(b"")
        if late:
            fresh = list({c for _, _, new in late for _, c in new})
            self.learn(fresh)
            for k, found, new in late:
                for i, c in new:
                    found[i] = get(c)
                out[k] = b"".join(found)
            if len(self.known) > CACHE:
                self.known.clear()
                self.known[""] = b""
        return out


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, so that its tasks share what it remembers."""
    return ChunkTokenizer(path)


remembers(chunk_tokenizer.cache_clear)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, capacity: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = chunk_tokenizer(path), np.array([END], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            texts = [x or "" for x in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in PIECES.types], schema=PIECES)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy("packing", _cut(tokenizer or default_tokenizer(), capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is the largest that fits into room, none used more often than counts has it."""
    reach, steps, goal = 1, [], 1 << room
    mask = 2 * goal - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:  # the multiplicity in binary parts
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, take = left - take, 2 * take
            if reach & goal:
                break
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return out[::-1]


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns as (number of bins, lengths in a bin)."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        lengths = [seed, *fullest(counts, capacity - seed)]
        counts[seed] += 1
        used: dict[int, int] = {}
        for n in lengths:
            used[n] = used.get(n, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        out.append((times, lengths))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, arrays over the patterns that hold it: first rank, first bin, pieces of it per bin, and where the first lies."""
    out: dict[int, list] = {}
    first = 0
    rank: dict[int, int] = {}
    for times, lengths in patterns:
        at = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            out.setdefault(n, []).append((rank.get(n, 0), first, k, at))
            rank[n] = rank.get(n, 0) + times * k
            at += n * k
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def _numbered(length: int, names: list[str]):
    """Adds _part, the writing task, and _rank, the number of pieces of the same length that the task has seen before."""

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            n = b.column(length).to_numpy(zero_copy_only=False)
            rank = np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            values, starts, sizes = np.unique(n[order], return_index=True, return_counts=True)
            for v, at, k in zip(values.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                before = seen.get(v, 0)
                rank[order[at : at + k]] = np.arange(before, before + k)
                seen[v] = before + k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], names=[*names, "_part", "_rank"])

    return numbered


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length of 1 to capacity) with sequence_id and offset added."""
    spark = pieces.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = stored(pieces.mapInArrow(_numbered(pieces.columns.index("length"), pieces.columns), f"{kinds}, _part int, _rank long"), "pieces")
    counts = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("length", "_part", "_n", earlier.alias("_before")), "starts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    placed = spark.sparkContext.broadcast(places(minimum_bin_slack(histogram, capacity)))  # capacity patterns at most: each uses a length up
    ranked = dealt.join(starts.drop("_n"), ["length", "_part"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = placed.value
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for v in np.unique(n):
            at = np.flatnonzero(n == v)
            ranks, bins, per, where = table[int(v)]
            p = np.searchsorted(ranks, r[at], "right") - 1
            k = r[at] - ranks[p]
            seq[at], off[at] = bins[p] + k // per[p], where[p] + k % per[p] * v
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_at", place("length", F.col("_rank") + F.col("_before"))).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
