"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

One pass over the texts splits them into words, lists the places where a base
phrase's words stand consecutively, and notes which of the templates' words a
text holds. The words themselves are kept only where these are enough for some
template. All further steps read that small table:

Each template's distinct words are ordered by how many documents hold them,
rarest first. A block whose share of a template's words reaches the threshold
holds at least one of the template's first ``size - required + 1`` words, so an
equi-join on those finds all candidates; the length filter (too few distinct
words), the positional filter (too few words after the first match) and at last
the exact intersection decide. Blocks are windows of ``2 * STRIDE`` words that
start every STRIDE words: any passage of up to STRIDE words lies whole in one.

Base labels always count, with score 1.

Defined results: null and empty texts have no words, no labels and score 0.
Every input row gives one output row, repeated ones too; doc_id may be null.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import LOWER, UPPER, stored, table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum() or c in UPPER)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed by the contract: phrase and label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Sentences by which a text declares its license; each has STRIDE distinct words at most.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
]
THRESHOLD = 0.9
STRIDE = 32


def words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_words(templates: list[tuple[str, str]]) -> list[list[str]]:
    out = [sorted(set(words(t))) for _, t in templates]
    if any(not 0 < len(w) <= STRIDE for w in out):
        raise ValueError(f"a template needs 1 to {STRIDE} distinct words")
    return out


def required(size: int, threshold: float) -> int:
    """The least overlap whose share of a template of this size reaches the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def split_words(text: Column) -> Column:
    """The text's words, lower-cased.

    A word is only ever compared with ASCII words, so letters beyond A-Z may be
    lower-cased too, but for the one whose small form is ASCII: the Kelvin sign.
    """
    low = F.btrim(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), F.lit(SEPARATORS))
    return F.when(low != "", F.split(low, SEPARATOR)).otherwise(F.array().cast("array<string>"))


def prefix_table(spark: SparkSession, counts: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """A row for each word of each template's prefix: token, pos, label, size, need, tokens (rarest first). counts: token, df. As small as the templates."""
    sets = template_words(templates)
    rows = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(required(len(s), threshold)).alias("need"), _strings(s).alias("tokens")) for i, ((label, _), s) in enumerate(zip(templates, sets, strict=True))])
    listed = spark.range(1).select(F.inline(rows)).select("tid", "label", "need", F.explode("tokens").alias("token"))
    ordered = listed.join(counts, "token", "left").groupBy("tid", "label", "need").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("s"))
    ordered = ordered.withColumn("tokens", F.transform("s", lambda x: x["token"])).withColumn("size", F.size("tokens"))
    return ordered.select("label", "size", "need", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.col("size") - F.col("need") + 1)).alias("pos", "token"))


def phrase_starts(w: Column, phrase: str) -> Column:
    """Word positions, from 0, where the phrase's words stand consecutively in the array w."""
    parts = phrase.split(" ")
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - len(parts), F.lit(0)))

    def here(i: Column) -> Column:
        same = [F.get(w, i + k) == p for k, p in enumerate(parts)]
        return F.coalesce(same[0] if len(same) == 1 else F.expr("true") & same[0] & _all(same[1:]), F.lit(False))

    return F.filter(places, here)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _read(docs: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], threshold: float) -> DataFrame:
    """The pass over the texts: _row, doc_id, n_words, n_base, first_word, last_word, base, found (template words), and w (all words) where some template may be contained."""
    sets = template_words(templates)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", split_words(text).alias("w"))
    every_word = F.array_intersect("w", _strings(sorted({w for s in sets for w in s} | {w for p, _ in phrases for w in p.split(" ")})))
    rows = rows.withColumn("_known", every_word)
    starts = [F.when(_all([F.array_contains("_known", w) for w in p.split(" ")]), phrase_starts(F.col("w"), p)).otherwise(F.array().cast("array<int>")) for p, _ in phrases]
    rows = rows.select("*", *[s.alias(f"_s{i}") for i, s in enumerate(starts)])
    every = F.concat(*[f"_s{i}" for i in range(len(phrases))])
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"_s{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))))
    enough = [F.size(F.array_intersect("_known", _strings(s))) >= required(len(s), threshold) for s in sets]
    least = min((required(len(s), threshold) for s in sets), default=0)
    maybe = (F.size("_known") >= least) & _either(enough) if enough else F.lit(False)
    return rows.select("_row", "doc_id", F.size("w").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"), F.col("_known").alias("found"), F.when(maybe, F.col("w")).alias("w"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks."""
    read = stored(_read(docs, templates, phrases, threshold), "read")
    counts = read.select(F.explode("found").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    prefix = stored(prefix_table(docs.sparkSession, counts, templates, threshold), "templates")
    marks = _strings(sorted(r[0] for r in prefix.select("token").distinct().collect()))  # words of the templates only
    head = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("w") - STRIDE - 1, F.lit(0))) / STRIDE).cast("int")), lambda k: F.slice("w", k * STRIDE + 1, F.lit(2 * STRIDE)))
    blocks = read.filter("w IS NOT NULL").select("_row", *head, F.explode_outer(F.filter(windows, lambda b: F.arrays_overlap(b, marks))).alias("block"))
    probes = blocks.withColumn("block", F.array_distinct("block")).withColumn("token", F.explode_outer(F.array_intersect("block", marks)))
    pairs = probes.join(prefix, "token", "left")
    # the first of a template's words that a block holds stands for the pair, so each pair is verified once
    first = ~F.arrays_overlap("block", F.slice("tokens", F.lit(1), F.col("pos")))
    fits = (F.size("block") >= F.col("need")) & (F.col("size") - F.col("pos") >= F.col("need")) & first
    overlap = F.when(fits, F.size(F.array_intersect("block", "tokens")))
    hit = F.when(overlap >= F.col("need"), overlap / F.col("size"))
    judged = pairs.withColumn("share", hit).groupBy("_row").agg(
        *[F.first(c).alias(c) for c in head],
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("labels"),
        F.max("share").alias("share"),
        F.count("share").alias("n_blocks"),
    )
    without = read.filter("w IS NULL").select("_row", *head, F.array().cast("array<string>").alias("labels"), F.lit(None).cast("double").alias("share"), F.lit(0).cast("long").alias("n_blocks"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return without.unionByName(judged).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "labels")), ",").alias("labels"), score.alias("score"), "n_blocks")


def _either(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    phrases = ", ".join(f"({quoted(p.split(' '))}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({i}, '{label}', {quoted(s)}, {required(len(s), THRESHOLD)})" for i, ((label, _), s) in enumerate(zip(TEMPLATES, template_words(TEMPLATES), strict=True)))
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), p(parts, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(parts)) = parts)) AS i FROM d, p
), b AS (
  SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY doc_id
), t(tid, label, tokens, need) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, unnest(list_transform(range(greatest(len(w) - {STRIDE} - 1, 0) // {STRIDE} + 1), lambda k: list_distinct(list_slice(w, k * {STRIDE} + 1, k * {STRIDE} + {2 * STRIDE})))) AS block FROM d
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(block, tokens)) / len(tokens)) AS share, count(*) AS n_blocks
  FROM blocks, t WHERE len(list_intersect(block, tokens)) >= need GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
  coalesce(array_to_string(b.base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.share, 0.0)::DOUBLE END AS score, coalesce(found.n_blocks, 0) AS n_blocks
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN found USING (doc_id)
"""


SQL = _sql()
