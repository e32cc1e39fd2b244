"""Exact deduplication by Grace hash partitioning.

Level 0 of the partitioning is Spark's own shuffle on the content's digest. What
a task then gets is put into an open-addressing table that compares complete
contents; where that outgrows its budget the records are dealt to spill files by
further bits of their hash, recursively, until each file fits. Equal contents
within a scan task are folded together first, so that a text which makes up a
third of all rows reaches the shuffle once per task.

Defined results: a null text counts as empty; empty texts are equal to each
other. Rows that repeat both text and doc_id are one row's identity: they are
kept or dropped alike. A null doc_id never wins over a number; if a group has
only nulls, keep_id is null and its rows are kept. Other columns are ignored.
Two contents with the same SHA-256 digest fall into the same table, which
raises an error instead of merging them. The stage drops a row by its doc_id and
text together, so rows that share a doc_id but not the text are judged apart; a
row without a doc_id goes if its text's group has a number.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm._common import ascii_lower, join_hot, small_batches, stored, tidy

#: Bytes of distinct content that one table may hold before it spills.
TABLE_BYTES = 64 << 20
#: Spill files per level, and the bits of the hash that choose among them.
FANOUT, BITS = 16, 4

Record = tuple[str, str, int | None, int]  # digest, content, largest doc_id, rows


def content(text: Column) -> Column:
    """What is compared: the text with A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class ContentTable:
    """Open addressing with linear probing; a slot of the same hash and digest must hold the same complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, record: Record) -> None:
        digest, text, doc_id, n = record
        h = xxhash.xxh3_64_intdigest(digest)
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            row = self.rows[i]
            if self.hashes[i] == h and row[0] == digest:
                if row[1] != text:
                    raise ValueError(f"two contents share the digest {digest}")
                row[2], row[3] = larger(row[2], doc_id), row[3] + n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.hashes.append(h)
        self.rows.append([digest, text, doc_id, n])
        self.bytes += sys.getsizeof(text) + 300
        if 3 * len(self.rows) > 2 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for i, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def grace(records: Iterable[Record], budget: int, depth: int = 0) -> Iterator[list]:
    """One row for each distinct content. Spill files belong to the task and vanish with it; a rerun writes its own."""
    table, files = ContentTable(), []
    try:
        for record in records:
            if not files:
                table.add(record)
                if table.bytes <= budget or len(table.rows) < 2 or depth * BITS >= 60:
                    continue
                files = [tempfile.TemporaryFile() for _ in range(FANOUT)]
                for row in table.rows:
                    spill(files, row, depth)
                table = ContentTable()
            else:
                spill(files, record, depth)
        yield from table.rows
        while files:
            with files.pop() as f:
                f.seek(0)
                yield from grace(unspilled(f), budget, depth + 1)
    finally:
        for f in files:
            f.close()


def spill(files: list, record, depth: int) -> None:
    h = xxhash.xxh3_64_intdigest(record[0], seed=1)
    pickle.dump(tuple(record), files[h >> (BITS * depth) & FANOUT - 1], protocol=5)


def unspilled(f) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)


def _batch(rows: list, names: list[str], keep: list[int]) -> pa.RecordBatch:
    kinds = {"digest": pa.string(), "content": pa.string(), "keep_id": pa.int64(), "group_size": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in zip(keep, names, strict=True)], names)


def _folded(budget: int):
    """Within a scan task: equal contents become one record. Full tables are emitted and started anew."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = ["digest", "content", "keep_id", "group_size"], ContentTable()
        for record in _records(batches):
            table.add(record)
            if table.bytes > budget:
                yield from _chunks(table.rows, names)
                table = ContentTable()
        yield from _chunks(table.rows, names)

    return fold


def _chunks(rows: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 1000):
        yield _batch(rows[i : i + 1000], names, [0, 1, 2, 3])


def _tabled(budget: int):
    def tabled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in grace(_records(batches), budget):
            out.append((row[0], row[2], row[3]))
            if len(out) == 10_000:
                yield _batch(out, ["digest", "keep_id", "group_size"], [0, 1, 2])
                out = []
        yield _batch(out, ["digest", "keep_id", "group_size"], [0, 1, 2])

    return tabled


def duplicate_groups(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct content: digest, keep_id, group_size."""
    small_batches(docs.sparkSession)
    text = content(F.col("text"))
    keyed = docs.select(F.sha2(text, 256).alias("digest"), text.alias("content"), F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    folded = keyed.mapInArrow(tidy("exact_dedup", _folded(budget)), "digest string, content string, keep_id long, group_size long")
    return folded.repartition(F.col("digest")).mapInArrow(tidy("exact_dedup", _tabled(budget)), "digest string, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(content(F.col("text")), 256).alias("digest"))
    groups = stored(duplicate_groups(docs, budget), "groups")
    return join_hot(rows, groups, ["digest"], "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """docs, all columns, without the rows that an equal text with a larger doc_id replaces."""
    gone = exact_duplicates(docs, budget).filter(~F.col("kept")).select(F.col("doc_id").alias("__larkspan_gone"), F.col("text_sha256").alias("__larkspan_digest")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__larkspan_gone")) & (F.sha2(content(F.col("text")), 256) == F.col("__larkspan_digest"))
    return docs.join(gone, same, "left_anti")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
