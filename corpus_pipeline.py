"""The training-corpus pipeline: toxicity, exact dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, extra ones included. A clean document passes
all of them: toxic documents go, of equal texts the largest doc_id stays, of
near duplicates the smallest, secrets are replaced by their kind in brackets,
and what is left is packed into sequences. Empty input gives empty output; the
stages treat nulls as their operators say, and rows without a doc_id are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import exact_dedup, ngram_jaccard, packing, secret_scan, toxicity
from larkspan.llm._common import discard, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_documents),
]

#: Tokenization and the trained stages can't be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is a table in the shared folder, removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
