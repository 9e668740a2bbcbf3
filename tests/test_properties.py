"""Properties of the rows-only (model) operators."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksmith.operators import models as M
from stacksmith.operators import stacking as STK
from stacksmith.operators.knn import knn_join
from stacksmith.operators.sampling import kfold, stratified_holdout, stratified_kfold
from stacksmith.operators.selftrain import StopState, select_step, should_stop

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    from stacksmith.plans.models_q import train_test
    return train_test(spark, SF)


def test_fold_sizes_per_class_differ_by_at_most_one(spark, frame):
    train, _ = frame
    sizes = train.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in sizes)


def test_folds_invariant_to_partitioning(spark, frame):
    train, _ = frame
    base = train.select("row_id", "label")
    a = {r.row_id: r.fold for r in stratified_kfold(base, 5, 42, "label").collect()}
    b = {r.row_id: r.fold for r in stratified_kfold(base.repartition(7), 5, 42, "label").collect()}
    c = {r.row_id: r.fold for r in kfold(base.repartition(3), 5, 42).collect()}
    d = {r.row_id: r.fold for r in kfold(base, 5, 42).collect()}
    assert a == b and c == d


def test_holdout_size(spark, frame):
    train, _ = frame
    h = stratified_holdout(train.select("row_id", "label"), 0.2, 42, "label")
    per = {r.label: (r.n, r.h) for r in h.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_holdout").cast("int")).alias("h")).collect()}
    for n, held in per.values():
        assert held == round(n * 0.2 + 1e-9) or abs(held - n * 0.2) <= 0.5


def test_oof_every_row_scored_once_and_no_leak(spark, frame):
    train, test = frame
    from stacksmith.plans.models_q import FEATS
    factory = lambda: M.scaled_pipeline(FEATS, M.make_estimator("logistic", weight="weight"))
    oof = STK.oof_scores(train, test, "lr", factory, 5)
    tr = oof.filter(F.col("split") == "train")
    assert tr.count() == train.count()
    assert tr.select("row_id").distinct().count() == train.count()
    # each row's OOF score comes from the model of its own fold, which did not see it
    joined = tr.join(train.select("row_id", F.col("fold").alias("own")), "row_id")
    assert joined.filter(F.col("fold") != F.col("own")).count() == 0
    te = oof.filter(F.col("split") == "test")
    assert te.count() == 5 * test.count()
    assert oof.filter((F.col("proba") < 0) | (F.col("proba") > 1)).count() == 0


def test_selection_never_repeats_and_respects_ratio(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(p)) for i, p in enumerate(rng.random(400))]
    df = spark.createDataFrame(rows, "row_id long, p double")
    taken = df.filter("p > 0.95").select("row_id")
    out = select_step(df, taken, 0.8, 0.3, 1.5)
    pos = out.filter("pseudo_label = 1").count()
    neg = out.filter("pseudo_label = 0").count()
    assert neg <= int(1.5 * pos)
    assert out.join(taken, "row_id").count() == 0
    assert out.select("row_id").distinct().count() == out.count()


def test_stop_rules():
    st = StopState()
    assert not should_stop(st, 0.5, 10)
    assert should_stop(st, 0.5, 10, patience=1)        # no gain
    st2 = StopState()
    assert not should_stop(st2, 0.5, 0, patience=5)
    assert should_stop(st2, 0.6, 0, patience=5)       # two empty steps


def test_knn_exact_against_numpy(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=(120, 5)).round(1)          # rounded: many ties
    ref[10:30] = ref[0]                               # a hot duplicate group
    qs = rng.normal(size=(15, 5)).round(1)
    k = 17
    rdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ref)], "rid long, vec array<double>")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "qid long, vec array<double>")
    got = {}
    for r in knn_join(qdf, rdf, k, n_pivots=6).collect():
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    for qi, qv in enumerate(qs):
        # left-to-right sum, as Spark's aggregate (Python's sum() is compensated)
        d2 = [reduce(lambda acc, t: acc + t, [(float(a) - float(b)) * (float(a) - float(b)) for a, b in zip(qv, rv)], 0.0)
              for rv in ref]
        exp = [rid for _, rid in sorted((d, i) for i, d in enumerate(d2))[:k]]
        assert [rid for _, rid in sorted(got[qi])] == exp


def test_rank_by_value_with_hot_ties(spark):
    from stacksmith.operators.rank import rank_by_value
    rows = [(i, 0.25) for i in range(500)] + [(1000 + i, round(0.001 * (i % 97), 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, p double")
    got = {r.row_id: r.rank for r in rank_by_value(df, "p", "row_id", tie_width=16).collect()}
    exp = {rid: i + 1 for i, (p, rid) in enumerate(sorted((p, rid) for rid, p in rows))}
    assert got == exp


def test_log_bucket_monotone(spark):
    from stacksmith.operators.rank import log_bucket
    rng = np.random.default_rng(3)
    xs = sorted(set([0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.0, 2.0, -2.0, 1e300, float("inf"), float("-inf")]
                    + list(rng.normal(size=300) * 10.0 ** rng.integers(-8, 9, size=300))))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r.b for r in df.select("x", log_bucket("x").alias("b")).orderBy("x").collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_quantiles_long_tail(spark):
    from stacksmith.operators.profile import exact_quantiles
    vals = [float(i) for i in range(1, 400)] + [1e12, -5.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = [r.value for r in exact_quantiles(df, "x", [], probs).orderBy("q").collect()]
    assert got == [round(float(v), 6) for v in np.quantile(np.array(vals), probs)]


def test_rank_lookup_against_brute_force(spark):
    from stacksmith.operators.rank import rank_lookup
    rng = np.random.default_rng(5)
    vals = [float(v) for v in np.concatenate([rng.normal(size=200) * 1e4, np.zeros(50), np.full(100, -3.5)])]
    probes = [float(v) for v in [-1e9, -3.5, 0.0, 0.5, 1e9] + list(rng.normal(size=20) * 1e4)]
    vdf = spark.createDataFrame([(v,) for v in vals], "x double")
    pdf = spark.createDataFrame([(i, v) for i, v in enumerate(probes)], "pid int, x double")
    got = {r.pid: (r.count_le, r.count_lt) for r in rank_lookup(vdf, pdf, "x").collect()}
    for i, p in enumerate(probes):
        assert got[i] == (sum(v <= p for v in vals), sum(v < p for v in vals))


def test_prefix_max_as_of(spark):
    from stacksmith.operators.rank import fixed_bucket, prefix_max
    rows = [(g, r, float(r * 2) if r % 3 == 0 else None) for g in (0, 1) for r in range(0, 40)]
    df = spark.createDataFrame(rows, "g int, r long, v double")
    got = {(x.g, x.r): x.m for x in prefix_max(df, ["r"], "v", fixed_bucket("r", 7), ["g"], out="m").collect()}
    for g, r, _ in rows:
        assert got[(g, r)] == float((r // 3) * 3 * 2)


# ------------------------------------------------------- no caps, exact values

def test_text_terms_keep_accents_and_single_letters(spark):
    from stacksmith.operators.models import tfidf_terms
    docs = spark.createDataFrame([(1, "Vièle à l'été a_b"), (2, "other"), (3, None)], "row_id long, text string")
    got = {r.term for r in tfidf_terms(docs).filter("row_id = 1").collect()}
    assert got == {"vièle", "à", "l", "été", "a_b"}


def test_indexed_one_hot_has_no_category_limit(spark):
    from stacksmith.operators.features import IndexedOneHot
    n = 20_000
    train = spark.range(n).selectExpr("id", "concat('v', id) as c").unionByName(spark.range(3).selectExpr("id", "cast(null as string) as c"))
    enc = IndexedOneHot.fit(train, "c")
    idx = [r.idx for r in enc.transform(train, "id").collect()]
    assert sorted(idx) == list(range(n))
    assert enc.transform(spark.createDataFrame([(1, "new")], "id long, c string"), "id").count() == 0


def test_subset_search_over_seventeen_models(spark):
    from stacksmith.operators.scores import subset_search
    import random
    rng = random.Random(3)
    models = [f"m{i}" for i in range(17)]
    rows = [(rng.randint(0, 1), *[rng.random() for _ in models]) for _ in range(40)]
    out = subset_search(spark.createDataFrame(rows, "y int, " + ", ".join(f"{m} double" for m in models)), "y", models)
    got = {r["mask"]: (r.tp, r.fp, r.fn) for r in out.filter("mask in (1, 5, 70001, 131071)").collect()}
    assert out.count() == (1 << 17) - 1
    for mask, counts in got.items():
        own = [i for i in range(17) if mask >> i & 1]
        hit = [sum(r[1 + i] for i in own) / len(own) > 0.5 for r in rows]
        assert counts == (sum(h and r[0] == 1 for h, r in zip(hit, rows)), sum(h and r[0] == 0 for h, r in zip(hit, rows)),
                          sum(not h and r[0] == 1 for h, r in zip(hit, rows)))


def test_best_threshold_is_taken_on_exact_f1(spark):
    from stacksmith.operators.scores import best_threshold
    sweep = spark.createDataFrame([(0.1, 0.70000001), (0.2, 0.70000004)], "threshold double, f1 double")
    assert best_threshold(sweep).first().best_threshold == 0.2


def test_merges_refuse_unmatched_keys(spark):
    from stacksmith.operators.joins import LengthMismatch, attach_ids, merge_on_key
    ids = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "row_id long, id long")
    pred = spark.createDataFrame([(1, 0), (2, 1), (9, 1)], "row_id long, state int")
    for call in (lambda: attach_ids(pred, ids), lambda: merge_on_key(ids, pred)):
        with pytest.raises(LengthMismatch):
            call()
    assert attach_ids(pred.replace(9, 3, "row_id"), ids).count() == 3


def test_one_class_clusters_keep_their_rows(spark):
    from pyspark.ml.linalg import Vectors
    from stacksmith.operators.models import cluster_then_classify, clustered_cv_vote
    rows = [(i, Vectors.dense([10.0 * (i % 2) + 0.01 * i, 1.0 * (i % 3)]), float(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, ["row_id", "features", "label"])
    assert clustered_cv_vote(df, df, "features", 2, 3, "logistic").count() == 80
    assert cluster_then_classify(df, df, "features", 2, "logistic").count() == 80


def test_two_level_offsets_equal_a_plain_running_sum(spark):
    from pyspark.sql import functions as F
    from stacksmith.operators.rank import fixed_bucket, prefix_sum
    df = spark.range(5000).selectExpr("cast(id as double) as v", "id % 7 as w")
    got = {r.v: r.w_cum for r in prefix_sum(df, ["v"], ["w"], fixed_bucket("v", 1.0)).collect()}
    total = 0
    for i in range(5000):
        total += i % 7
        assert got[float(i)] == total


def test_settings_leave_a_cluster_alone():
    from stacksmith.session import default_conf
    for key in ("spark.driver.host", "spark.driver.memory", "spark.sql.shuffle.partitions", "spark.driver.bindAddress"):
        assert key not in default_conf("yarn") and key not in default_conf("local-cluster[2,1,1024]") and key in default_conf("local[4]")


def test_dense_text_vectors_against_plain_numpy(spark):
    import hashlib
    import math
    import re
    texts = ["the cat sat", "the cat sat", "The dog, the dog! ran", "", None, "cat " * 500 + "mat", "é ß 中文 a_b"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r.row_id: np.array(r.vec) for r in M.dense_text_vectors(df).collect()}
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    for i, w in enumerate(words):
        v = np.zeros(384)
        for t in sorted(set(w)):
            weight = w.count(t) * math.log((len(texts) + 1) / (sum(t in x for x in words) + 1))
            bits = b"".join(hashlib.md5(f"dense:{j}:{t}".encode()).digest() for j in range(3))
            v += weight * (np.unpackbits(np.frombuffer(bits, np.uint8)) * 2.0 - 1.0)
        want = v / np.linalg.norm(v) if w else v
        assert got[i].shape == (384,) and np.abs(got[i] - want).max() < 1e-6
    assert (got[0] == got[1]).all() and not got[3].any() and not got[4].any()


def test_standardised_arrays(spark):
    from stacksmith.operators.features import standardised_arrays
    fit = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<float>")
    other = spark.createDataFrame([([2.0, 6.0],)], "v array<float>")
    a, b = standardised_arrays(fit, "v", fit, other)
    assert sorted(r.v for r in a.collect()) == [[-1.0, 0.0], [1.0, 0.0]] and b.collect()[0].v == [0.0, 1.0]


@pytest.mark.parametrize("k, block", [(3, 16), (40, 16), (500, 64)])
def test_knn_blocks_do_not_change_the_result(spark, k, block):
    rng = np.random.default_rng(k)
    ref, qs = rng.normal(size=(300, 12)).round(1), rng.normal(size=(50, 12)).round(1)
    ref[50:150] = ref[7]
    qs[5] = ref[7]
    rdf = spark.createDataFrame([(f"r{i:03d}", [float(x) for x in v], float(i % 2)) for i, v in enumerate(ref)], "rid string, vec array<double>, label double")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "qid long, vec array<double>")
    got = {}
    for r in knn_join(qdf, rdf, k, n_pivots=5, block=block, keep_ref=("label",)).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.rid, r.label))
    for qi, qv in enumerate(qs):
        d2 = np.zeros(len(ref))
        for j in range(12):
            d2 += (qv[j] - ref[:, j]) * (qv[j] - ref[:, j])
        want = sorted(range(300), key=lambda i: (d2[i], i))[:k]
        assert sorted(got[qi]) == [(n + 1, f"r{i:03d}", float(i % 2)) for n, i in enumerate(want)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("hot_rows", [10, 10 ** 6])
def test_overlap_with_hot_endpoints(spark, monkeypatch, closed, hot_rows):
    from stacksmith.operators import overlap
    monkeypatch.setattr(overlap, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    a[:120] = 20
    b[60:200] = 40
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, s long, e long")
    got = {r.id: r.n_overlap for r in overlap.overlap_count(df, "s", "e", closed=closed).collect()}
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    for i in range(300):
        if closed:
            want = ((lo <= hi[i]) & (hi >= lo[i])).sum() - 1
        else:
            want = ((lo < hi[i]) & (hi > lo[i]) & (lo < hi)).sum() - 1 if lo[i] < hi[i] else 0
        assert got[i] == want
