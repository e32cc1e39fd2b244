"""Every operator and stage on odd and on empty tables: defined results, no crash."""

import hashlib

import corpus_pipeline
from larkspan.llm import exact_dedup, html_text, license_scan, ngram_jaccard, packing, secret_scan, sentencepiece_codec, topk_search, toxicity, url_filter

EMPTY = hashlib.sha256(b"").hexdigest()


def rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


def test_licenses(odd_docs, no_docs):
    out = rows(license_scan.scan_licenses(odd_docs))
    assert len(out) == 12
    by = {r.doc_id: r for r in out}
    assert by[3].n_words == by[4].n_words == 0 and by[3].labels == "" and by[3].score == 0.0 and by[3].first_word is None
    assert by[6].n_words == 60_000
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_packing(odd_docs, no_docs):
    out = packing.packed(odd_docs).collect()
    assert sorted(r.length for r in out if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert len([r for r in out if r.doc_id == 2]) == 2
    seen = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seen.get(r.sequence_id, 0)
        seen[r.sequence_id] = r.offset + r.length
    assert max(seen.values()) <= 2048
    assert packing.packed(no_docs).count() == 0


def test_near_duplicates(odd_docs, no_docs):
    out = rows(ngram_jaccard.near_duplicates(odd_docs))
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == 12
    assert by[1].class_id == by[2].class_id == 1 and by[7].class_id == by[6].class_id == 6 and by[6].n_links == 1
    assert by[3].n_links == by[4].n_links == by[5].n_links == 0 and by[4].class_id == 4
    assert all(r.n_links == 0 and r.class_id is None for r in out if r.doc_id is None)
    assert ngram_jaccard.near_duplicates(no_docs).count() == 0


def test_secrets(odd_docs, no_docs):
    out = rows(secret_scan.scan_secrets(odd_docs))
    assert len(out) == 12 and all(r.base_sha256 == EMPTY and r.spans == "" for r in out)
    assert secret_scan.scan_secrets(no_docs).count() == 0


def test_toxicity(odd_docs, no_docs, odd_labels):
    out = rows(toxicity.scored(odd_docs, odd_labels))
    assert len(out) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert toxicity.scored(no_docs, odd_labels).count() == 0
    assert toxicity.scored(odd_docs, odd_labels.limit(0)).count() == 12


def test_sentencepiece(odd_docs, no_docs):
    out = rows(sentencepiece_codec.digests(odd_docs))
    assert len(out) == 12 and all(r.round_trip for r in out)
    assert {r.n_ids for r in out if r.doc_id in (3, 4)} == {0}
    assert sentencepiece_codec.digests(no_docs).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://NET", "http://NET/", "a://b://x.net/", "https://x.EXAMPLE.net/en/1", "https://example.com/de/?q", "http://notexample.com/de/", "http://x.org/fr/#a", "http://u@a.net:80/", "http://.net/", "http:///x"]
    df = spark.createDataFrame([(i // 2, u, "r", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, _key string, host int")
    out = url_filter.judge_urls(df, url_filter.rule_table(spark))
    got = {r.url: (r.host, r.path, r.rule, r.verdict, r._key) for r in out.collect()}
    assert out.count() == len(urls)
    assert got[None] == got[""] == got["no scheme"] == ("", "", None, "allow", "x")
    assert got["http://NET"] == ("net", "", None, "allow", "x") and got["http://NET/"][2:4] == ("net/", "block")
    assert got["a://b://x.net/"][0] == "b:" and got["https://x.EXAMPLE.net/en/1"][2:4] == ("example.net/en/", "allow")
    assert got["https://example.com/de/?q"][2:4] == ("example.com/de/", "block") and got["http://notexample.com/de/"][2] is None
    assert got["http://x.org/fr/#a"][2:4] == ("org/fr/", "allow") and got["http://u@a.net:80/"][2] is None
    none = url_filter.rule_table(spark, [])
    assert {r.verdict for r in url_filter.judge_urls(df, none).collect()} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_html(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (3, "u", "plain &amp; text"), (4, "u", "<article><p>" + "word " * 50_000 + "</article>"), (5, "u", "<a b='<div>'><!-- x"), (6, "u", "<script>if (a<b) '</p>'</script>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = rows(html_text.extracted(df), "page_id")
    assert [r.n_chars for r in out if r.page_id in (1, 2, 5, 6)] == [0, 0, 0, 0]
    assert next(r for r in out if r.page_id == 4).n_chars == 249_999
    assert html_text.extracted(df.limit(0)).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [-1.0]), (8, []), (20, [2.0, 2.0, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    out = topk_search.top_k(df, df.filter("vec_id % 20 = 0"), 3).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20)}
    assert got[0] == [(20, 64 * 128 + 32 * 128), (1, 64 * 64 + 32 * 32), (2, 64 * 64 + 32 * 32)]
    assert got[20][0] == (0, 64 * 128 + 32 * 128)
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk_search.top_k(df, df.limit(0)).count() == 0


def test_exact_dedup(odd_docs, no_docs):
    out = exact_dedup.exact_duplicates(odd_docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == 12 and by[1][0].keep_id == 2 and not by[1][0].kept and all(r.kept and r.group_size == 3 for r in by[2])
    assert by[3][0].keep_id == 4 and by[4][0].group_size == 3 and by[4][0].text_sha256 == EMPTY
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_stages(spark, odd_docs, no_docs, odd_labels, tmp_path):
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        held = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            held = out
        last = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
        kept = {r.doc_id for r in last}
        assert kept == ({2, 4, 5, 6, 8, 9, None} if docs is odd_docs else set())


def test_rows_that_share_a_doc_id_are_judged_apart(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, "dup"), (9, "dup"), (5, "unique"), (None, "dup"), (None, "alone"), (7, base), (7, "something else entirely, of other words"), (8, base + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = sorted((r.doc_id or 0, r.text) for r in exact_dedup.without_exact_duplicates(df).collect())
    assert exact == sorted([(i or 0, t) for i, t in rows if t != "dup"] + [(9, "dup")])
    near = sorted((r.doc_id or 0, r.text) for r in ngram_jaccard.without_near_duplicates(df).collect())
    assert near == sorted((i or 0, t) for i, t in rows if (i, t) not in ((9, "dup"), (8, base + " end")))
    out = {(r.doc_id, r.n_shingles): (r.class_id, r.n_links) for r in ngram_jaccard.near_duplicates(df).collect() if r.doc_id is not None}
    assert out[7, 96] == (7, 1) and out[8, 97] == (7, 1) and out[7, 2] == (7, 0)


def test_workers_forget_other_operators(spark):
    """A worker process that goes on to another operator holds the first one's memories no longer."""
    from larkspan.llm import _common

    def packs(batches):
        for b in batches:
            packing.chunk_tokenizer(packing.default_tokenizer())(["some text"])
            yield b

    def counts(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing.chunk_tokenizer.cache_info().currsize])], ["id"])

    one = spark.range(1).coalesce(1)
    assert one.mapInArrow(_common.tidy("packing", packs), "id long").count() == 1
    assert max(r.id for r in spark.range(8).repartition(4).mapInArrow(_common.tidy("packing", counts), "id long").collect()) >= 0
    assert {r.id for r in spark.range(8).repartition(4).mapInArrow(_common.tidy("toxicity", counts), "id long").collect()} == {0}
    packing.chunk_tokenizer(packing.default_tokenizer())
    _common.works_for("packing")
    assert packing.chunk_tokenizer(packing.default_tokenizer()) is packing.chunk_tokenizer(packing.default_tokenizer())
    _common.works_for("exact_dedup")
    assert packing.chunk_tokenizer.cache_info().currsize == 0
