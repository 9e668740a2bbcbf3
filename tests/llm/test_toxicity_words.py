"""Operator 7 against plain Python: document frequencies of all words, exact cosines over all of them."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stacksmith.llm import queries as Q
from stacksmith.llm import text as T
from stacksmith.llm import toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def hashed(word):
    b = np.frombuffer(word.encode(), np.uint8)
    return int(T.word_hashes(b, np.array([0]), np.array([len(b)]))[0])


def test_words_and_neighbours_against_plain_python(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model, vocabulary, _ = toxicity.fit(docs, labels)
    number = dict(zip(vocabulary.hashes.tolist(), vocabulary.number.tolist()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    # Every word of every example is a term, and its idf comes from all documents.
    count = {d: Counter(words(t)) for d, t in texts.items()}
    df = Counter(w for c in count.values() for w in c)
    of = {w: number.get(hashed(w)) for w in df}
    ordinary = 0
    for d in toxic:
        for w in count[d]:
            idf = math.log((1 + len(texts)) / (1 + df[w])) + 1
            assert model.idf[of[w]] == pytest.approx(idf * (1 if of[w] < vocabulary.labelled else toxicity.ORDINARY))
            ordinary += of[w] >= vocabulary.labelled
    assert ordinary > 1000

    def vector(d):
        first, terms, counts = vocabulary.rows(1, *rows(texts[d]))
        plain = {of[w]: n for w, n in count[d].items() if of[w] is not None}
        got = dict(zip(terms.tolist(), counts.tolist()))
        assert {t: got[t] for t in plain} == plain
        v = np.zeros(len(model.idf))
        v[terms] = (1 + np.log(counts)) * model.idf[terms]
        return v / (np.linalg.norm(v) or 1)

    def rows(text):
        _, _, w, doc, h, _ = next(toxicity._terms(toxicity.pa.array([text])))
        return w, doc, h

    examples = {d: vector(d) for d in toxic if count[d]}
    got = {r.doc_id: r for r in Q.QUERIES["op7_toxicity"](spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    for d in texts:
        if not count[d] or not (v := vector(d)).any():
            continue
        best = sorted((float(v @ e) for e in examples.values()), reverse=True)
        near = json.loads(got[d].evidence) if got[d].evidence else []
        assert bool(near) == (best[0] > 1e-12)
        if near:
            assert near[0]["similarity"] == pytest.approx(best[0], abs=1e-9)
            assert all(n["similarity"] == pytest.approx(float(v @ examples[n["doc_id"]]), abs=1e-9) for n in near)


def test_texts_of_ordinary_words_get_their_own_scores(spark, sf):
    scores = {r.score for r in Q.QUERIES["op7_toxicity"](spark, sf.replace("0.001", "0.01")).collect()}
    assert len(scores) > 50 and all(0 <= s <= 1 for s in scores)


def test_a_very_long_text_of_one_word_and_empty_vocabularies(make_docs, spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(i, f"{'slur' if k < 12 else 'kind'} same words here u{i}") for k, i in enumerate(ids)] + [(1000, "slur " * 200_000), (1001, "none of these known"), (1002, "... !")]
    labels = spark.createDataFrame([(i, int(k < 12)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(make_docs(rows), labels).collect()}
    assert min(got[i] for i in ids[:12]) > max(got[i] for i in ids[12:])
    assert got[1001] == got[1002] == pytest.approx(12 / 40)
    assert got[1000] > 0.5
