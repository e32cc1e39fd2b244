"""Names and numbers that must be unique."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONGEST = 32


def unique_names(rows: DataFrame, base: str, order: str) -> DataFrame:
    """rows with name: the base cut to LONGEST, or with -2, -3 and so on, whichever no row before (by order) holds.

    Names can only meet within a family, the bases that agree in their beginning
    once numbers at their end are taken off; a family is gone through in order.
    """
    stem = F.regexp_replace(F.rtrim(F.substring(base, 1, LONGEST), F.lit("-")), r"(-[0-9]+)+$", "")
    family = F.rtrim(F.substring(stem, 1, LONGEST - 8), F.lit("-"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, taken, following = None, set(), {}
        for f in frames:
            out = []
            for fam, text in zip(f["_family"], f[base], strict=True):
                if fam != held:
                    held, taken, following = fam, set(), {}
                text = text or ""
                name, k = text[:LONGEST].rstrip("-"), following.get(text, 2)
                while name in taken:
                    tail = f"-{k}"
                    name, k = text[: LONGEST - len(tail)].rstrip("-") + tail, k + 1
                following[text] = k
                taken.add(name)
                out.append(name)
            yield f.drop(columns="_family").assign(name=out)

    dealt = rows.withColumn("_family", F.coalesce(family, F.lit("")))
    return dealt.repartition("_family").sortWithinPartitions("_family", order).mapInPandas(named, f"{fields}, name string")


def free_numbers(rows: DataFrame, order: str, taken: DataFrame) -> DataFrame:
    """rows with id: the lowest numbers from 1 that taken (id) doesn't hold, in the order given.

    The k-th free number is k plus the taken ones below it. Taken numbers are
    turned into steps (from which k on how many are skipped), and one window over
    both sides looks each row's step up.
    """
    n = rows.withColumn("_k", F.row_number().over(W.orderBy(order)).cast("long"))
    used = taken.filter("id >= 1").select("id").distinct().withColumn("_skip", F.row_number().over(W.orderBy("id")).cast("long"))
    steps = used.groupBy((F.col("id") - F.col("_skip") + 1).alias("_k")).agg(F.max("_skip").alias("_skip"))
    both = n.select(*rows.columns, "_k", F.lit(None).cast("long").alias("_skip")).unionByName(steps, allowMissingColumns=True)
    upto = F.coalesce(F.max("_skip").over(W.orderBy("_k").rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    return both.withColumn("id", F.col("_k") + upto).filter(F.col(order).isNotNull()).select(*rows.columns, "id")
