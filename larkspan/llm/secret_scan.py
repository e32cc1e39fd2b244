"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio, in DataFrame operations only.

The models are first-order chains over ALPHABET with a start state, one of
random strings and one of ordinary identifiers, with add-half smoothing. They
are trained from strings made by rule, random ones and identifiers (GENERATED of
each), and as further identifiers the words of all documents, without what the
patterns match there. The documents' transitions are counted whole and then
scaled to CORPUS_SHARE times as many as the made identifiers have, so that
identifiers weigh the same however much text there is.
A token of MIN_TOKEN or more characters is a span of kind ``markov`` if its
log-likelihood ratio exceeds THRESHOLD and no base span overlaps it.

Positions are code points, end exclusive; a span is the whole match.

Defined results: a null or empty text has no spans; base_sha256 is then the
digest of the empty string and spans is empty. Every input row gives one output
row. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import stored, table

#: Fixed by the contract: kind, pattern, group that is measured, least length, and a cheap pattern that any match holds.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),  # maximal runs of [0-9a-f]+ that are long enough
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: start, or a character outside the alphabet
MIN_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 12.0
GENERATED = 2000
BLOCK = 128
FAR = 2**31 - 1
#: How many transitions the documents' words count for, by those of the made identifiers.
CORPUS_SHARE = 3.0
IDENTIFIER_WORDS = (
    "user name file path data index value count list item node page request response error handler config server client cache key "
    "table column row query result status message event time start end begin create update delete insert select find get set read "
    "write open close parse format string number array object class method function module package version build test check verify "
    "account session token access address email phone order price total amount product category image title content header footer"
).split()


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of an array of ints from 0 on. Each is taken over its block of BLOCK and the sum of the blocks before, so that long arrays stay cheap."""

    def over(v: Column) -> Column:
        total = lambda part: F.aggregate(part, F.lit(0), join)
        block = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        numbers = F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int"))
        heads = bound(F.transform(numbers, lambda b: total(block(b))), lambda sums: F.transform(numbers, lambda b: F.struct(b.alias("b"), total(F.slice(sums, F.lit(1), b)).alias("head"))))
        within = lambda part, head: F.transform(part, lambda x, i: join(head, total(F.slice(part, F.lit(1), i + 1))))
        return F.flatten(F.transform(heads, lambda h: bound(block(h["b"]), lambda part: within(part, h["head"]))))

    return bound(values, over)


NO_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, group: int, least: int, quick: str, kind: int) -> Column:
    """Leftmost non-overlapping matches whose group is long enough: array of (start, kind, end, value), value being the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)  # what stands before, between and after the matches
    steps = lambda m: F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
    ends = lambda m: running(steps(m), lambda s, x: s + x)
    spans = bound(found, lambda m: F.zip_with(F.arrays_zip(m.alias("m"), held.alias("v")), ends(m), lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.when(F.length(x["v"]) >= least, x["m"]).alias("value"))))
    return F.coalesce(F.when(text.rlike(quick), F.filter(spans, lambda s: s["value"].isNotNull())), F.array().cast(NO_SPANS))


def higher(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. In order of their starts, a span overlaps one before it that ends after its start, or the next one if that starts before its end."""
    inside = lambda x: x["kind"] < len(KINDS)

    def among(every: Column) -> Column:
        ends = running(F.transform(every, lambda x: F.when(inside(x), x["end"]).otherwise(0)), higher)
        # starts from the back, as distances from FAR, so that the nearest one is the greatest
        starts = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(inside(x), FAR - x["start"]).otherwise(0)), higher))
        return bound(ends, lambda e: bound(starts, lambda s: F.filter(every, lambda x, i: ~inside(x) & (F.get(e, i) <= x["start"]) & (FAR - F.get(s, i) >= x["end"]))))

    return F.when(F.size(base) == 0, tokens).otherwise(bound(F.array_sort(F.concat(base, tokens)), among))


MADE, RANDOM, CORPUS = 0, 1, 2


def labelled_strings(docs: DataFrame, generated: int = GENERATED) -> DataFrame:
    """value, source, n: strings made by rule (MADE, RANDOM), and the words of all documents (CORPUS), each once with how often it occurs."""
    ids = docs.sparkSession.range(generated)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    based = F.base64(F.unhex(digest))
    part = lambda c: F.substring(c, 1, 40)
    random = ids.select(F.explode(F.array(part(digest), part(based), F.translate(F.upper(part(based)), "+/=", ""), F.translate(part(based), "+/=", "-_"))).alias("value"), F.lit(RANDOM).alias("source"))
    vocabulary = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    word = lambda k: F.get(vocabulary, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    some = [word(k) for k in range(4)]
    made = F.array(F.concat_ws("_", *some), F.concat(some[0], *[F.initcap(w) for w in some[1:]]), F.concat_ws("-", *some[:3]), F.upper(F.concat_ws("_", *some[:3])), F.concat_ws("/", *some), F.concat(some[0], some[1], (F.col("id") % 100).cast("string")))
    ordinary = ids.select(F.explode(made).alias("value"), F.lit(MADE).alias("source"))
    text = F.coalesce("text", F.lit(""))
    for name, pattern, *_, quick in KINDS:
        text = F.regexp_replace(text, pattern, " ") if name == "access" else F.when(text.rlike(quick), F.regexp_replace(text, pattern, " ")).otherwise(text)
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("value"))
    corpus = words.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select("value", F.lit(CORPUS).alias("source"), "n")
    return random.unionByName(ordinary).withColumn("n", F.lit(1).cast("long")).unionByName(corpus)


def state(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def likelihood_ratios(strings: DataFrame) -> list[float]:
    """log P(next | previous) under the random model less the same under the identifier model, at previous * STATES + next."""
    n = F.length("value")
    pairs = strings.filter(n > 0).select("source", "n", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.when(i > 1, state(F.substring(F.col("value"), i - 1, 1))).otherwise(0).alias("a"), state(F.substring(F.col("value"), i, 1)).alias("b")))).alias("p"))
    counts = pairs.groupBy("source", "p.a", "p.b").agg(F.sum("n").alias("n")).collect()  # 3 * STATES ** 2 rows at most
    totals = [sum(k for source, *_, k in counts if source == which) for which in (MADE, RANDOM, CORPUS)]
    scale = {MADE: 1.0, RANDOM: 1.0, CORPUS: CORPUS_SHARE * totals[MADE] / max(1, totals[CORPUS])}
    n = [[0.0] * (STATES * STATES) for _ in range(2)]
    for source, a, b, k in sorted(counts):
        n[source == RANDOM][a * STATES + b] += scale[source] * k
    of = [[sum(n[r][a * STATES : (a + 1) * STATES]) for a in range(STATES)] for r in range(2)]
    p = lambda r, a, b: math.log((n[r][a * STATES + b] + 0.5) / (of[r][a] + 0.5 * STATES))
    return [round(p(1, a, b) - p(0, a, b), 6) for a in range(STATES) for b in range(STATES)]


def ratio(token: Column, model: Column) -> Column:
    """The token's log-likelihood ratio."""
    states = F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), state))
    return F.aggregate(F.zip_with(F.slice(states, F.lit(1), F.size(states) - 1), F.slice(states, F.lit(2), F.size(states) - 1), lambda a, b: F.get(model, a * STATES + b)), F.lit(0.0), lambda s, x: s + x)


def secret_spans(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with __larkspan_base and __larkspan_spans added: arrays of (start, kind, end, value), sorted; kind is an index into KINDS, or len(KINDS) for markov."""
    if model is None:
        model = likelihood_ratios(labelled_strings(docs))
    held = F.from_json(F.lit(json.dumps(model)), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[matches(text, p, g, least, quick, k) for k, (_, p, g, least, quick) in enumerate(KINDS)]))
    tokens = matches(text, TOKEN, 0, MIN_TOKEN, TOKEN, len(KINDS))
    random = F.filter(apart(F.col("__larkspan_tokens"), F.col("__larkspan_base")), lambda t: ratio(t["value"], held) > threshold)
    return docs.withColumn("__larkspan_base", base).withColumn("__larkspan_tokens", tokens).withColumn("__larkspan_spans", F.when(F.size("__larkspan_tokens") == 0, F.col("__larkspan_base")).otherwise(F.array_sort(F.concat("__larkspan_base", random)))).drop("__larkspan_tokens")


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    found = secret_spans(docs.select("doc_id", "text"), model).select("doc_id", "__larkspan_base", "__larkspan_spans")
    of = lambda k: F.size(F.filter("__larkspan_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate([*[k[0] for k in KINDS], "markov"])]
    return found.select("doc_id", *counts, F.sha2(listed("__larkspan_base"), 256).alias("base_sha256"), listed("__larkspan_spans").alias("spans"))


def redacted(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """docs, all columns, with every span replaced by [kind]; n_chars, if there, is the new text's length. Other rows stay as they are."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("markov"))
    found = secret_spans(docs, model)
    # spans can overlap across kinds: each is written from where the last one ended
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(new.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    text = F.when(F.size("__larkspan_spans") == 0, F.col("text")).otherwise(F.aggregate("__larkspan_spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("__larkspan_spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
