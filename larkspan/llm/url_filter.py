"""URL filtering: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

A rule is a host and a path prefix. A url's possible rules are its host's
suffixes (at label boundaries) joined with its path's prefixes of the lengths
that occur in the list. Those that the filter lets pass go to an equi-join with
the list, which removes false positives; the longest rule decides. Urls without
a candidate take no part in the join and aren't shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule. Every input row gives one output row, repeated ones too. A host is
compared as written up to the first / ? or #, with A-Z lower-cased. A rule
listed with both verdicts blocks. An empty list leaves the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import LOWER, UPPER, ascii_lower, stored, table

#: Words of 32 bits in a block; a key sets one bit in each.
WORDS = 8
SALTS = [((2 * i + 1) * 0x9E3779B97F4A7C15 >> 24) & 0xFFFFFFFF | 1 for i in range(WORDS)]
BITS_PER_KEY = 16
#: The filter that is broadcast never exceeds this; longer lists get more false positives, which the join removes.
MAX_FILTER_BYTES = 8 << 20
DEFAULT = "allow"
#: The list of this contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A list written out in code, as a table: verdict, host, path."""
    row = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r, strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(row)) if rules else spark.createDataFrame([], "verdict string, host string, path string")


def block_and_mask(key: str, blocks: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key)
    low, mask = h & 0xFFFFFFFF, 0
    for i, salt in enumerate(SALTS):
        mask |= 1 << (32 * i + ((low * salt & 0xFFFFFFFF) >> 27))
    return (h >> 32) % blocks, mask


def blocked_filter(keys: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> list[int]:
    """The filter over the column ``key``: a 256-bit integer per block. Built on the executors; the driver gets the finished words, max_bytes at most."""
    n = keys.count()
    blocks = max(1, min(max_bytes // 32, -(-n * BITS_PER_KEY // 256)))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: dict[int, int] = {}
            for key in f["key"]:
                at, mask = block_and_mask(key, blocks)
                for i in range(WORDS):
                    out[at * WORDS + i] = out.get(at * WORDS + i, 0) | mask >> 32 * i & 0xFFFFFFFF
            yield pd.DataFrame({"slot": list(out), "word": list(out.values())}, dtype="int64")

    merged = keys.select("key").mapInPandas(words, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word"))
    held = [0] * blocks
    for slot, word in merged.toLocalIterator():
        held[slot // WORDS] |= word << 32 * (slot % WORDS)
    return held


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of all rules that could fit."""
    heads = [path[:k] for k in lengths if k <= len(path)]
    out, rest = [], host
    while rest and heads:
        out += [rest + head for head in heads]
        _, dot, rest = rest.partition(".")
    return out


def judge_urls(urls: DataFrame, rules: DataFrame, column: str = "url", default: str = DEFAULT, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """urls with host, path, rule and verdict added (columns of these names are replaced)."""
    spark = urls.sparkSession
    listed = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != "")).groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    listed = listed.withColumn("key", F.concat("rule_host", "rule_path"))
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())  # at most as many as a url has characters
    held = spark.sparkContext.broadcast(blocked_filter(listed, max_bytes))

    @F.pandas_udf("array<string>")
    def possible(host: pd.Series, path: pd.Series) -> pd.Series:
        blocks, cache = held.value, {}

        def passes(key: str) -> bool:
            if (hit := cache.get(key)) is None:
                at, mask = block_and_mask(key, len(blocks))
                if len(cache) > 100_000:
                    cache.clear()
                hit = cache[key] = blocks[at] & mask == mask
            return hit

        return pd.Series([[k for k in candidate_keys(h, p, lengths) if passes(k)] for h, p in zip(host, path, strict=True)], dtype=object)

    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"),
        ascii_lower(F.coalesce(F.regexp_extract(column, URL, 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract(column, URL, 2), F.lit("")).alias("path"),
        F.monotonically_increasing_id().alias("_row"),
    )
    probed = stored(parsed.withColumn("_keys", possible("host", "path")), "probed")
    probes = probed.filter(F.size("_keys") > 0).withColumn("_key", F.explode("_keys")).drop("_keys")
    hits = probes.join(listed.select(F.col("key").alias("_key"), "rule_host", "rule_path", "rule_verdict"), "_key", "left")
    # the host's and the path's boundary is compared too: a key alone doesn't tell them apart
    fits = F.col("rule_host").isNotNull() & F.col("path").startswith(F.col("rule_path")) & ((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host"))))
    best = F.max(F.when(fits, F.struct(F.length("_key").alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("verdict"), F.col("_key").alias("rule")))).alias("_best")
    judged = hits.groupBy("_row").agg(F.first("_in").alias("_in"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    some = judged.select("_in.*", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    none = probed.filter(F.size("_keys") == 0).select("_in.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return none.unionByName(some)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).drop("url")


SQL = f"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}),
f AS (
  SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM f WHERE k = 1
"""
