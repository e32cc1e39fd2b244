"""Interval operators over integer times: unions, sessions, sliding windows, overlaps, pieces, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_length(df: DataFrame, keys: list[str], start: str = "t0", end: str = "t1") -> DataFrame:
    """keys, busy: the length of the union of each key's intervals."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    added = F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start)))
    return df.withColumn("_add", F.greatest(added, F.lit(0).cast("long"))).groupBy(*keys).agg(F.sum("_add").alias("busy"))


def gap_sessions(df: DataFrame, keys: list[str], gap: int, ties: list[str], start: str = "t0", end: str = "t1", slice_: int = 86_400_000_000) -> DataFrame:
    """df with session, from 0: a new one begins where a row starts more than gap after the previous row's end.

    Rows are numbered within slices of time, so a key isn't one task; of each
    slice its first start, last end and number of new sessions go on to the next
    ones. df is read twice.
    """
    rows = df.withColumn("_slice", F.floor(F.col(start) / slice_))
    order = W.partitionBy(*keys, "_slice").orderBy(start, *ties)
    inner = F.col(start) - F.lag(end).over(order) > gap
    rows = rows.withColumn("_first", F.lag(end).over(order).isNull() & (F.row_number().over(order) == 1)).withColumn("_new", F.coalesce(inner, F.lit(True)).cast("long") - F.col("_first").cast("long"))
    at = F.struct(start, *ties)
    parts = rows.groupBy(*keys, "_slice").agg(F.min(start).alias("_from"), F.max_by(end, at).alias("_to"), F.sum("_new").alias("_n"))
    along = W.partitionBy(*keys).orderBy("_slice")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(along) > gap, F.lit(True)).cast("long")
    parts = parts.withColumn("_opens", opens).withColumn("_at", F.sum(F.col("_opens") + F.col("_n")).over(along) - F.col("_n") - 1)
    numbered = rows.withColumn("_in", F.sum("_new").over(order)).join(parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_at"), F.expr(" AND ".join([*[f"{k} <=> _k{i}" for i, k in enumerate(keys)], "_slice = _s"])))
    return numbered.select(*df.columns, (F.col("_at") + F.col("_in")).alias("session"))


def worst_window(df: DataFrame, keys: list[str], width: int, start: str = "t0", end: str = "t1") -> DataFrame:
    """keys, worst, worst_from: the most time on, in any window of that width, and the first window that has it: by start of an interval, else by end.

    A best window begins at a start or ends at an end. Rows and windows meet by
    buckets of the width, so no key's rows are paired with all others; intervals
    are width long at most.
    """
    spans = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    mark = lambda lo, kind: F.struct(lo.alias("_lo"), F.lit(kind).alias("_kind"))
    marks = spans.select(*keys, F.inline(F.array(mark(F.col("_s"), 0), mark(F.col("_e") - width, 1)))).groupBy(*keys, "_lo").agg(F.min("_kind").alias("_kind"))
    bucket = lambda c: F.floor(c / width)
    marks = marks.withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")) - 1, bucket(F.col("_lo")) + 1)))
    met = marks.join(spans.withColumn("_b", bucket(F.col("_s"))), [*keys, "_b"])
    on = F.greatest(F.lit(0).cast("long"), F.least(F.col("_e"), F.col("_lo") + width) - F.greatest(F.col("_s"), F.col("_lo")))
    totals = met.groupBy(*keys, "_lo", "_kind").agg(F.sum(on).alias("_on"))
    best = totals.groupBy(*keys).agg(F.max(F.struct(F.col("_on"), (-F.col("_kind")).alias("_k"), (-F.col("_lo")).alias("_first"))).alias("_b"))
    return best.select(*keys, F.col("_b._on").alias("worst"), (-F.col("_b._first")).alias("worst_from"))


def shortest_pause(df: DataFrame, keys: list[str], start: str = "t0", end: str = "t1") -> DataFrame:
    """keys, pause: the least time from an end to the next start; negative where intervals overlap, null for a single one."""
    order = W.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("_p", F.lead(start).over(order) - F.col(end)).groupBy(*keys).agg(F.min("_p").alias("pause"))


def overlaps(df: DataFrame, ident: str, condition, longest: int, start: str = "t0", end: str = "t1", band: tuple[str, str] | None = None, cell: int = 1_000_000) -> DataFrame:
    """Pairs a, b (structs of df's columns, a's ident smaller) that overlap in time and meet condition(a, b).

    Intervals meet in buckets of their longest length; with band, the columns of
    centre and width in Hz of a condition that asks for less than half the sum of
    both widths between the centres, also in cells of frequency. A pair that
    shares several is taken in the last of both first buckets and cells only.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    first = lambda c: F.floor(c / longest)
    centre, width = (F.col(band[0]), F.col(band[1])) if band else (F.lit(0), F.lit(0))
    low = lambda f, w: F.floor((f - w / 2) / cell)
    held = df.select(row.alias("r"), low(centre, width).alias("f"), F.explode(F.sequence(low(centre, width), F.floor((centre + width / 2) / cell))).alias("c"), F.sequence(first(F.col(start)), first(F.greatest(F.col(end) - 1, F.col(start)))).alias("ks"))
    held = held.select("r", "f", "c", F.explode("ks").alias("k"))
    a, b = held.select(F.col("r").alias("a"), F.col("f").alias("fa"), "c", "k"), held.select(F.col("r").alias("b"), F.col("f").alias("fb"), "c", "k")
    met = a.join(b, ["k", "c"]).filter(F.col(f"a.{ident}") < F.col(f"b.{ident}"))
    once = (F.col("k") == F.greatest(first(F.col(f"a.{start}")), first(F.col(f"b.{start}")))) & (F.col("c") == F.greatest("fa", "fb"))
    return met.filter(once & (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}")) & condition(F.col("a"), F.col("b"))).select("a", "b")


def pieces(frames: DataFrame, others: DataFrame, ident: str) -> DataFrame:
    """Cuts each frame (ident, t0, t1) where the others that overlap it (ident, o0, o1) begin or end: ident, lo, hi."""
    edges = frames.select(ident, F.explode(F.array("t0", "t1")).alias("lo"), "t1")
    inner = others.join(frames, ident).select(ident, F.explode(F.array("o0", "o1")).alias("lo"), "t0", "t1").filter("lo > t0 AND lo < t1").select(ident, "lo", "t1")
    cut = edges.unionByName(inner).distinct()
    return cut.withColumn("hi", F.lead("lo").over(W.partitionBy(ident).orderBy("lo"))).filter("hi IS NOT NULL").select(ident, "lo", "hi")


def as_of(facts: DataFrame, states: DataFrame, keys: list[str], at: str, value: Column, tie: str) -> DataFrame:
    """facts with state: the value of the last state at or before them (states: keys, at, tie), by one window instead of a range join."""
    named = [c for c in facts.columns]
    left = facts.select(*named, F.lit(None).cast("string").alias("_v"), F.lit(1).alias("_side"))
    right = states.select(*[F.col(c) if c in (*keys, at, tie) else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in named], value.cast("string").alias("_v"), F.lit(0).alias("_side"))
    order = W.partitionBy(*keys).orderBy(at, "_side", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    return left.unionByName(right).withColumn("state", F.last("_v", ignorenulls=True).over(order)).filter("_side = 1").drop("_v", "_side")


def half_parity(df: DataFrame, keys: list[str], order: list[str], split: Column) -> DataFrame:
    """df with part: 0 for rows that aren't split, else 1 and 2 in turn within a key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(split.cast("long")).over(w)
    return df.withColumn("part", F.when(split, F.when(n % 2 == 1, 1).otherwise(2)).otherwise(0).cast("long"))
