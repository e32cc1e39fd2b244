"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from larkspan.llm import exact_dedup, html_text, license_scan, ngram_jaccard, packing, secret_scan, sentencepiece_codec, topk_search, toxicity, url_filter
from larkspan.llm._common import table


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scans": license_scan.op1_license_scans,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": ngram_jaccard.op3_ngram_jaccard_join,
    "op4_secret_scans": secret_scan.op4_secret_scans,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_exact_topk_search": topk_search.op9_exact_topk_search,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_license_scans": license_scan.SQL,
    "op7_url_filters": url_filter.SQL,
    "op9_exact_topk_search": topk_search.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
