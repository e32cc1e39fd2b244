"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Arrow batches hold at most this many rows, so that a batch of very long texts stays small.
BATCH_ROWS = 1000


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session without one gets a folder of its own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspan-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


#: Folders written by stored() and not removed yet.
_held: dict[str, None] = {}


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there and a lost executor loses nothing.

    What isn't discarded before is removed when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/larkspan-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    fs, p = _folder(spark, folder)
    fs.deleteOnExit(p)
    _held[folder] = None
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._larkspan_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    if (folder := getattr(df, "_larkspan_folder", None)) is not None:
        _remove(df.sparkSession, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    fs, p = _folder(spark, folder)
    fs.delete(p, True)
    _held.pop(folder, None)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows, stored; what make() itself stored on the way is removed."""
    before = set(_held)
    out = stored(make(), name)
    for folder in [f for f in _held if f not in before and f != out._larkspan_folder]:
        _remove(spark, folder)
    return out


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, parts: int = 256) -> DataFrame:
    """Inner equi-join of left with right, which has each key once and in column count how many rows of left have it.

    A key with more than 1/parts of all rows is dealt over several tasks: fewer
    than parts keys can be that frequent, so their table is small enough to
    broadcast. right is read three times and should be stored.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // parts)
    hot = right.filter((F.col(count) > share) & (F.lit(total) > parts)).select(*keys, F.ceil(F.col(count) / share).cast("int").alias("_parts"))
    if hot.isEmpty():
        return left.join(right, keys)
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"), F.lit(0))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", every).drop("_parts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


#: What empties the memories that a worker process keeps between its tasks, and the operator that it last worked for.
_memories: list[Callable[[], None]] = []
_works_for: list[str] = [""]


def remembers(forget: Callable[[], None]) -> None:
    """Names what empties a memory that an operator keeps in its worker processes."""
    _memories.append(forget)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def works_for(operator: str) -> None:
    """The process works for an operator from now on, and forgets what it remembers for another."""
    if _works_for[0] != operator:
        _works_for[0] = operator
        for forget in _memories:
            forget()
        give_back()


def tidy(operator: str, work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """work, for mapInArrow or mapInPandas, in a process that serves stage after stage, some of them idle beside the next one's: what it held goes when a task ends."""

    def tidied(batches: Iterable) -> Iterator:
        works_for(operator)
        try:
            yield from work(batches)
        finally:
            give_back()

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows; plans read the setting when they run, so it stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
