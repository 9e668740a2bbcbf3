"""Registered queries against DuckDB where SQL exists, and against plain Python on sf0.001 where it does not."""

import collections

import brute
import duckdb
import pytest
import zlib

from stacksmith.llm import queries as Q


@pytest.mark.parametrize("key", sorted(Q.ORACLE))
def test_duckdb(spark, sf, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(Q.ORACLE[key])
    cols = [c[0] for c in cur.description]
    df = Q.QUERIES[key](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_secret_scan(spark, sf, corpus):
    got = {r.doc_id: r for r in Q.QUERIES["op1_secret_scan"](spark, sf).collect()}
    assert len(got) == len(corpus)
    for doc, text in corpus:
        base = brute.secrets(text)
        r = got[doc]
        digest = brute.sha(",".join("%s:%d:%d" % s for s in base))
        count = collections.Counter(s[0] for s in base)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (count["assign"], count["access"], count["hex"], digest)
        assert {"%s:%d:%d" % s for s in base} <= set(r.spans.split(",")) | {""}


def test_url_filter(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in Q.QUERIES["op2_url_filter"](spark, sf).collect()}
    assert len(got) == len(pages)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    for p in pages:
        rest = p.url.partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(brute.LOW), slash + path
        fits = [(len(h + q), h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_packing(spark, sf, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = Q.QUERIES["op4_best_fit_packing"](spark, sf).collect()
    want = sorted((d,) + p for d, t in corpus for p in brute.pieces(tokenizer, t))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_license_scan(spark, sf, corpus):
    got = {r.doc_id: r for r in Q.QUERIES["op5_license_scan"](spark, sf).collect()}
    for doc, text in corpus:
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_lm_scores(spark, sf, corpus):
    import math

    got = {r.doc_id: r for r in Q.QUERIES["op6_lm_scoring"](spark, sf).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in corpus}
    counts = collections.Counter()
    for d, t in corpus:
        if not held[d]:
            counts.update([*brute.space_words(t), "\0end"])
    total, distinct = sum(counts.values()), len(counts)
    for d, t in corpus:
        words = [*brute.space_words(t), "\0end"]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel=1e-9)
        assert r.score < 0


def test_toxicity_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = Q.QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in rows if a.toxic == 1 for b in rows if b.toxic == 0]
    assert sum(pairs) / len(pairs) > 0.85


def test_ngram_jaccard(spark, sf, corpus):
    want = brute.near_duplicates(corpus)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.QUERIES["op9_ngram_jaccard_join"](spark, sf).collect()}
    assert got == want
