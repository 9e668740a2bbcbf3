"""Hand-computed micro fixtures (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from stacksmith.functions.metrics import binary_report
from stacksmith.operators import features as FE
from stacksmith.operators import profile as P
from stacksmith.operators import scores as SC
from stacksmith.operators.joins import LengthMismatch, attach_ids
from stacksmith.operators.overlap import overlap_count
from stacksmith.operators.sampling import stratified_kfold, undersample
from stacksmith.operators.selftrain import select_step
from stacksmith.plans.inputs import rates_frame
from stacksmith.sources.store import MetaStore
from stacksmith.session import scratch_dir


def approx(a, b, tol=1e-6):
    return a == pytest.approx(b, abs=tol)


def test_f1_currency_log1p(spark):
    df = spark.createDataFrame([(1, 1000.0, "GBP"), (2, 500.0, "USD"), (3, 250.0, "XXX"), (4, 0.0, None)],
                               "row_id int, goal double, currency string")
    out = (df.join(F.broadcast(rates_frame(spark)), "currency", "left")
             .select("row_id", F.log1p(F.col("goal") * F.coalesce("usd_rate", F.lit(1.0))).alias("g")))
    got = {r.row_id: r.g for r in out.collect()}
    for k, v in {1: 7.343426, 2: 6.216606, 3: 5.525453, 4: 0.0}.items():
        assert approx(got[k], v)


@pytest.fixture()
def intervals(spark):
    return spark.createDataFrame([("A", 1, 5), ("B", 5, 8), ("C", 9, 6), ("D", 10, 10)], "id string, s long, e long")


def test_f2_overlap_closed(spark, intervals):
    got = {r.id: r.n_overlap for r in overlap_count(intervals, "s", "e").collect()}
    assert got == {"A": 1, "B": 2, "C": 1, "D": 0}


def test_f2_overlap_open(spark, intervals):
    got = {r.id: r.n_overlap for r in overlap_count(intervals, "s", "e", closed=False).collect()}
    assert got == {"A": 0, "B": 1, "C": 1, "D": 0}


def test_f2_overlap_against_reference(spark, intervals):
    t = spark.createDataFrame([("T1", 4, 6), ("T2", 20, 30), ("T3", 8, 10)], "id string, s long, e long")
    got = {r.id: r.n_overlap for r in overlap_count(t, "s", "e", reference=intervals.select("s", "e")).collect()}
    assert got == {"T1": 3, "T2": 0, "T3": 3}


@pytest.mark.parametrize("method,expected,kw", [
    ("naive", [0.277778, 0.333333, 0.388889], {}),
    ("power", [0.144609, 0.299861, 0.555530], {"power": 4}),
    ("softmax", [0.300610, 0.332225, 0.367165], {"temperature": 1.0}),
    ("minmax", [0.0, 0.058824, 0.941176], {"power": 4}),
    ("rank", [0.166667, 0.333333, 0.5], {}),
    ("rank", [0.5, 0.333333, 0.166667], {"reverse": True}),
])
def test_f3_weight_methods(spark, method, expected, kw):
    f1 = spark.createDataFrame([("a", 0.5), ("b", 0.6), ("c", 0.7)], "model_id string, f1 double")
    got = {r.model_id: r.weight for r in SC.model_weights(f1, method, **kw).collect()}
    for m, e in zip("abc", expected):
        assert approx(got[m], e)
    assert approx(sum(got.values()), 1.0, 1e-5)


def test_f3_all_zero_scores_equal_weights(spark):
    f1 = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model_id string, f1 double")
    assert [r.weight for r in SC.model_weights(f1, "naive").collect()] == [0.5, 0.5]


@pytest.fixture()
def f4(spark):
    return spark.createDataFrame([(0.10, 0), (0.35, 1), (0.40, 0), (0.80, 1)], "p double, y int")


def test_f4_threshold_sweep(spark, f4):
    sw = SC.threshold_sweep(f4, "y", "p")
    assert sw.count() == 201
    best = SC.best_threshold(sw).first()
    assert approx(best.best_threshold, 0.1) and approx(best.best_f1, 0.8)
    at_half = sw.filter(F.col("threshold") == 0.5).first()
    assert approx(at_half.f1, 0.666667)


def test_f4_auc(spark, f4):
    assert approx(SC.auc(f4, "y", "p").first().auc, 0.75)


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1)], "p double, y int")
    assert approx(SC.auc(df, "y", "p").first().auc, 0.5)


@pytest.fixture()
def f5(spark):
    return spark.createDataFrame([(i, 1 if i <= 3 else 0) for i in range(1, 9)], "row_id long, label int")


def test_f5_stratified_folds(spark, f5):
    got = {r.row_id: r.fold for r in stratified_kfold(f5, 2, 42, "label").collect()}
    assert {k for k, v in got.items() if v == 0} == {2, 3, 4, 6, 8}


def test_f5_undersampling(spark, f5):
    got = {(r.row_id, r.label) for r in undersample(f5, 42, "label").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 0), (6, 0), (8, 0)}


def test_f6_subset_search(spark):
    df = spark.createDataFrame([(1, .9, .3, .6), (0, .2, .1, .7), (1, .6, .8, .2), (1, .4, .7, .9)],
                               "y int, m1 double, m2 double, m3 double")
    got = {r.members: r.f1 for r in SC.subset_search(df, "y", ["m1", "m2", "m3"]).collect()}
    exp = {"m1": .8, "m2": .8, "m3": .666667, "m1+m2": 1.0, "m1+m3": .8, "m2+m3": .5, "m1+m2+m3": 1.0}
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert approx(got[k], v)


@pytest.fixture()
def f7(spark):
    return spark.createDataFrame([("a", .95), ("b", .50), ("c", .09), ("d", .01), ("e", .05), ("f", .02), ("g", .97)],
                                 "row_id string, p double")


def test_f7_selection(spark, f7):
    taken = spark.createDataFrame([("g",)], "row_id string")
    out = select_step(f7, taken, 0.8, 0.1, 2)
    got = {(r.row_id, r.pseudo_label) for r in out.collect()}
    assert got == {("a", 1), ("d", 0), ("f", 0)}


def test_f7_no_positive(spark, f7):
    taken = spark.createDataFrame([("g",), ("a",)], "row_id string")
    assert select_step(f7, taken, 0.8, 0.1, 2).count() == 0
    alt = select_step(f7, taken, 0.8, 0.1, 2, negatives_without_positives="all")
    assert {r.row_id for r in alt.collect()} == {"c", "d", "e", "f"}


def test_f8_one_hot_train_vocabulary(spark):
    train = spark.createDataFrame([("US",), ("GB",), ("US",)], "country string")
    test = spark.createDataFrame([(1, "US"), (2, "NZ"), (3, None)], "i int, country string")
    oh = FE.OneHot.fit(train, "country", "f03")
    assert oh.names() == ["f03__country__GB", "f03__country__US"]
    rows = test.select("i", *oh.columns()).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 1), (0, 0), (0, 0)]


def test_f9_inverse_one_hot(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (2, 0, 0, 0), (3, 1, 1, 0)], "i int, a int, b int, c int")
    out = df.select("i", FE.inverse_one_hot(["a", "b", "c"], ["2014Q1", "2014Q2", "2014Q3"]).alias("v"))
    assert {r.i: r.v for r in out.collect()} == {1: "2014Q2", 2: None, 3: "2014Q1"}


def test_f10_statistics(spark):
    q = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 10]], "x double")
    got = [r.value for r in P.exact_quantiles(q, "x", [], [0.1, 0.5, 0.9]).orderBy("q").collect()]
    assert [round(v, 6) for v in got] == [1.4, 3.0, 7.6]
    s = spark.createDataFrame([(float(x),) for x in [2, 4, 4, 4, 5, 5, 7, 9]], "x double")
    r = s.agg(F.stddev_pop("x").alias("p"), F.stddev_samp("x").alias("s")).first()
    assert approx(r.p, 2.0) and approx(r.s, 2.138090)
    rate = spark.createDataFrame([("k", 1), ("k", 0), ("k", 0), ("k", 0)], "g string, y int")
    assert approx(P.rate_table(rate, "g", "y").first().se, 0.216506)


def test_quantiles_with_hot_value(spark):
    # one value holding most rows collapses to one (value, count) row
    rows = [(5.0,)] * 300 + [(float(i),) for i in range(100)]
    df = spark.createDataFrame(rows, "x double")
    got = [r.value for r in P.exact_quantiles(df, "x", [], [0.25, 0.5, 0.75]).orderBy("q").collect()]
    import numpy as np
    exp = np.quantile(np.array([r[0] for r in rows]), [0.25, 0.5, 0.75])
    assert [round(v, 6) for v in got] == [round(v, 6) for v in exp]


def test_f11_meta_store_merge(spark):
    store = MetaStore(spark, scratch_dir(spark, "test-meta"))
    old = spark.createDataFrame([(1, "train", "m1", 0.1), (1, "train", "m2", 0.2)],
                                "row_id long, split string, model_id string, proba double")
    new = spark.createDataFrame([(1, "train", "m2", 0.7), (1, "train", "m3", 0.8)],
                                "row_id long, split string, model_id string, proba double")
    store.write(old)
    store.write(new)
    r = store.wide(["m1", "m2", "m3"]).first()
    assert (r.m1, r.m2, r.m3) == (0.1, 0.7, 0.8)


def test_f12_submission_length_mismatch(spark):
    ids = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "row_id long, id long")
    pred = spark.createDataFrame([(1, 1), (2, 0)], "row_id long, state int")
    with pytest.raises(LengthMismatch):
        attach_ids(pred, ids)


def test_binary_report_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    r = binary_report(df, "y", "p").first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)
