"""The pipeline's stages against plain-Python versions."""

import os
import sys

import brute

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as C  # noqa: E402
from stacksmith.llm import secrets, toxicity  # noqa: E402
from stacksmith.llm.shared import written  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stage = dict(C.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]

    clean = written(stage["toxicity"](spark, docs, sf), "t")
    assert clean.columns == docs.columns
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, s in score.items() if s < 0.5}

    single = written(stage["near_duplicates"](spark, clean, sf), "n")
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in clean.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (n, c) in groups.items() if d == c)

    free = written(stage["decontamination"](spark, single, sf), "d")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute.decontaminate([(r.doc_id, r.text) for r in single.collect()], items)
    assert {r.doc_id for r in free.collect()} == {d for d, h in hits.items() if h[1] == 0}

    masked = written(stage["secrets"](spark, free, sf), "s")
    assert masked.columns == docs.columns
    before = {r.doc_id: r for r in free.collect()}
    cuts = secrets.thresholds(free)
    for r in masked.collect():
        assert brute.secrets(r.text) == [] and r.n_chars == len(r.text)
        if not brute.secrets(before[r.doc_id].text) and not cuts:
            assert r.text == before[r.doc_id].text

    packed = stage["packing"](spark, masked, sf)
    assert {r.doc_id for r in packed.collect()} == set(before)
    last = C.run(spark, sf)
    assert sorted(map(tuple, last.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_secrets_stage_keeps_columns_whose_names_clash(spark):
    schema = "doc_id long, text string, n_chars long, spans string, __text string, __base int, __random int, __masked string"
    rows = [(1, "password=abcdefgh1 x", 20, "s", "t", 1, 2, "m"), (2, None, None, None, None, None, None, None), (3, "clean", 5, "s", "t", 1, 2, "m")]
    got = {r.doc_id: r for r in C.secret_stage(spark, spark.createDataFrame(rows, schema), "").collect()}
    assert got[1].text == "[SECRET] x" and got[1].n_chars == 10 and tuple(got[1])[3:] == rows[0][3:]
    assert tuple(got[2]) == rows[1] and tuple(got[3]) == rows[2]
