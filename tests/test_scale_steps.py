"""Steps whose cost must not grow faster than their input: what is written once, fitted side by side, or left out."""

import threading

import pytest
from pyspark.sql import functions as F

from stacksmith.operators import layered as LY
from stacksmith.operators import models as M
from stacksmith.operators import stacking as STK
from stacksmith.operators import wrapped  # noqa: F401
from stacksmith.plans import inputs, models_q

SF = "/root/testdata/sf0.001"
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float((i * 7 + i // 5) % 2), float(i % 11), float((i * i) % 13), float((i * 7 + i // 5) % 2 * 3 + i % 4), i % 3, 1.0) for i in range(240)]
    return STK.materialize(spark.createDataFrame(data, "row_id long, label double, a double, b double, c double, fold int, weight double"), "scale-rows").cache()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_holdout_parts_are_written(spark):
    """fits and scores read a table, not the ranks behind it."""
    for part in models_q._holdout_parts(spark, SF):
        assert "Window" not in plan(part) and "Join" not in plan(part)


def test_scores_of_one_split(spark):
    """one part of the score table is built alone, with the same rows."""
    whole = inputs.scores(spark, SF)
    for split in ("train", "test"):
        part = inputs.scores(spark, SF, split)
        want = whole.filter(F.col("split") == split)
        assert part.count() == want.count() and part.exceptAll(want).isEmpty()
    assert "Window" not in plan(inputs.scores(spark, SF, "test"))


def test_layer_returns_only_kept_columns(rows):
    """a layer that is asked for its importances does not write the features again."""
    layer = LY.FoldedLayer("base", COLS, {"nb": LY.model_on("naive_bayes")}, 3, 1e-6, 2)
    keep = ["row_id", "label", "fold", "origin"]
    scored = layer.fit(rows.withColumn("origin", F.lit("train")), keep)
    assert scored.columns == [*keep, "nb__base"] and scored.count() == 240


def _spy(at_once: threading.Barrier, name: str = "naive_bayes"):
    def make():
        at_once.wait(60)  # broken if the fits come one after another
        return M.scaled_pipeline(COLS, M.make_estimator(name, weight="weight"))
    return make


def test_folds_are_fitted_side_by_side(rows):
    """the fits of one model's folds do not wait for each other."""
    oof = STK.oof_scores(rows, None, "nb", _spy(threading.Barrier(3)), 3)
    assert oof.count() == 240 and {r.fold: r["count"] for r in oof.groupBy("fold").count().collect()} == {0: 80, 1: 80, 2: 80}


def test_runs_and_folds_share_the_slots(rows, monkeypatch):
    """a search of one run still fits several folds at a time."""
    spy = _spy(threading.Barrier(3))
    monkeypatch.setattr(STK.M, "scaled_pipeline", lambda cols, est, make=M.scaled_pipeline: (monkeypatch.setattr(STK.M, "scaled_pipeline", make), make)[1](cols, est))
    assert STK.run_experiments(rows, COLS, [("naive_bayes", {})], 3).count() == 1
    fits = STK._fold_fits(rows, spy, 3, "fold")
    assert len(STK.in_parallel(rows.sparkSession, fits, 3)) == 3


def test_top_k_folds_side_by_side(rows, monkeypatch):
    """importances of the folds are found at the same time."""
    at_once, real = threading.Barrier(3), M.importances
    monkeypatch.setattr(STK.M, "importances", lambda *a: (at_once.wait(120), real(*a))[1])
    out, chosen = STK.top_k_feature_member(rows, rows.limit(10), COLS, 2, 3)
    assert sorted(chosen) == [0, 1, 2] and all(len(c) == 2 for c in chosen.values()) and out.filter("split = 'train'").count() == 240


@pytest.mark.parametrize("name,params", [("cluster_then_classify", {"k": 2}), ("random_subspace", {"members": 3, "least": 1, "most": 2})])
def test_members_read_rows_that_are_kept_once(spark, rows, name, params, monkeypatch):
    """members are fitted on kept rows, which are given up afterwards."""
    levels = []
    real = wrapped._Common._member

    class Spy:
        def __init__(self, est):
            self.est = est

        def fit(self, df):
            levels.append("InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString())
            return self.est.fit(df)

    monkeypatch.setattr(wrapped._Common, "_member", lambda self, *a: Spy(real(self, *a)))
    plain = spark.createDataFrame(rows.collect(), rows.schema)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    M.scaled_pipeline(COLS, M.make_estimator(name, params, weight="weight")).fit(plain)
    assert levels and all(levels)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_term_weights_shuffle_each_term_row_once_a_join(spark):
    """F3, F8: counts are written once; the weights are not made twice to add up their norm."""
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (None, "a"), (2, "c d")], "row_id long, text string")
    terms = M.tfidf_terms(docs)
    text = plan(terms)
    assert text.count("Generate") == 0 and text.count("Relation") <= 2
    got = terms.collect()
    assert {r.row_id for r in got} == {1, 2} and len(got) == 5
    assert all(abs(sum(r.weight ** 2 for r in got if r.row_id == k) - 1) < 1e-9 for k in (1, 2))


def test_wrapped_models_hold_out_every_fold(spark, monkeypatch):
    """all five folds of the training rows are scored, not two of them, and test rows by every fold's model."""
    rows = [(i, i % 2, float(i % 11), float((i * i) % 13), float(i % 2 * 3 + i % 4), i // 2 % 5, 1.0) for i in range(200)]
    cols = ["f01__goal", "days_launch", "days_run"]
    train = spark.createDataFrame([(r[0], float(r[1]), *r[2:]) for r in rows], f"row_id long, label double, {', '.join(c + ' double' for c in cols)}, fold int, weight double")
    made = []
    monkeypatch.setattr(models_q, "train_test", lambda *a: (train, train.limit(7)))
    monkeypatch.setattr(models_q, "FEATS", cols)
    monkeypatch.setattr(models_q.M, "make_estimator", lambda name, *a, real=M.make_estimator, **p: (made.append((name, a)), real("naive_bayes", **p))[1])
    out = models_q.wrapped(spark, SF)
    got = {(r.model_id, r.split): (r.n, r.folds) for r in out.groupBy("model_id", "split").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("folds")).collect()}
    names = ("cluster_then_classify", "random_subspace", "soft_voting")
    assert got == {(m, s): (n, 5) for m in names for s, n in (("train", 200), ("test", 35))}
    assert sorted(made) == sorted((m, ()) for m in names for _ in range(5))  # no setting takes members away
