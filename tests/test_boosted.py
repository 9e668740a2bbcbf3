"""Boosted trees of all folds in the same passes (F1 wn08, F2 ev08): the models are MLlib's, fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksmith.operators import boosted as B
from stacksmith.operators import layered as LY
from stacksmith.operators import models as M
from stacksmith.operators import stacking as STK

COLS = ["a", "b", "c", "d", "none"]


@pytest.fixture(autouse=True)
def every_size(monkeypatch):
    monkeypatch.setattr(B, "SMALL", 0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 1500
    a, b, c, d = rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 2, n), np.round(rng.exponential(1, n), 1)
    y = a + 0.5 * b - c + 0.3 * d + rng.normal(size=n) > 1
    data = [(i, float(y[i]), float(a[i]), float(b[i]), float(c[i]), float(d[i]), None, i * 7 % 3, 1.5 if y[i] else 1.0) for i in range(n)]
    df = spark.createDataFrame(data, "row_id long, label double, a double, b double, c double, d double, none double, fold int, weight double")
    return STK.materialize(df.withColumn("origin", F.lit("train")), "boosted-rows")


def test_thresholds_at_equal_weights():
    assert B.edges_of(np.array([2.0, 1, 1, 4]), np.ones(4), 31).tolist() == [1.5, 3.0]
    assert B.edges_of(np.array([]), np.array([]), 3).tolist() == [] == B.edges_of(np.array([1.0, np.nan]), np.ones(2), 3).tolist()
    v = np.arange(100.0)
    assert B.edges_of(v, np.ones(100), 3).tolist() == [24.5, 49.5, 74.5]
    heavy = np.where(v < 10, 9.0, 1.0)
    assert B.edges_of(v, heavy, 1).tolist() == [9.5]


@pytest.mark.parametrize("weight", [None, "weight"])
def test_trees_of_all_folds_equal_mllib(rows, weight):
    """A feature of nulls alone and blocks that are filled up change nothing."""
    models = B.fit_folds(rows, COLS, 3, {"n_estimators": 4}, weight)
    for i in (0, 2):
        ml = M.scaled_pipeline(COLS[:4], M.make_estimator("gbt", {"n_estimators": 4}, weight=weight)).fit(rows.filter(F.col("fold") != i))
        want = [*ml.stages[-1].featureImportances.toArray(), 0.0]
        assert np.allclose(models[i].featureImportances.toArray(), want, atol=1e-9)
        both = M.score(ml, rows, ["row_id"]).join(M.score(models[i], rows, ["row_id"], "own"), "row_id")
        assert both.filter(F.abs(F.col("proba") - F.col("own")) > 1e-9).isEmpty() and both.count() == rows.count()


def test_layer_scores_each_row_by_its_own_fold(rows):
    """F1: the layer of wn08 grows its folds together and scores them in one pass."""
    layer = LY.FoldedLayer("base", COLS, {"gbt": LY.FoldedTrees({"n_estimators": 2}), "nb": lambda cols: LY.model_on("naive_bayes")(cols[:4])}, 3, 1e-6, 2)
    scored = layer.fit(rows, ["row_id", "label", "fold", "origin"])
    assert scored.columns == ["row_id", "label", "fold", "origin", "gbt__base", "nb__base"] and scored.count() == rows.count()
    for i in range(3):
        own = M.score(layer.models["gbt", i], rows.filter(F.col("fold") == i), ["row_id"])
        assert scored.join(own, "row_id").filter(F.abs(F.col("proba") - F.col("gbt__base")) > 1e-12).isEmpty()
    top = LY.top_features(LY.importance_table(rows.sparkSession, [layer]), "base", "gbt", 2).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and layer.f1["gbt", 0] > 0.5


def test_top_k_member_fits_no_trees_fold_by_fold(rows, monkeypatch):
    """one growth for all folds; before, an MLlib fit a fold read the rows again and again."""
    made, grown = [], []
    monkeypatch.setattr(STK.M, "make_estimator", lambda name, *a, real=M.make_estimator, **k: (made.append(name), real(name, *a, **k))[1])
    monkeypatch.setattr(STK.B, "fit_folds", lambda *a, real=B.fit_folds, **k: (grown.append(a[2]), real(*a, **k))[1])
    out, chosen = STK.top_k_feature_member(rows, rows.limit(5), COLS[:4], 2, 3)
    assert grown == [3] and made == ["logistic"] * 3 and sorted(chosen) == [0, 1, 2]
    assert out.count() == rows.count() + 15


def test_rows_of_one_class(spark):
    """Nothing to split: no importances, one probability."""
    df = spark.createDataFrame([(i, 1.0, float(i), i % 2) for i in range(20)], "row_id long, label double, a double, fold int")
    models = B.fit_folds(df, ["a"], 2, {"n_estimators": 2})
    assert [m.featureImportances.toArray().tolist() for m in models] == [[0.0], [0.0]]
    assert M.score(models[0], df, ["row_id"]).select("proba").distinct().count() == 1


def test_small_folds_are_left_to_mllib(rows, monkeypatch):
    monkeypatch.setattr(B, "SMALL", 10_000)
    layer = LY.FoldedLayer("base", COLS[:4], {"gbt": LY.FoldedTrees({"n_estimators": 2})}, 3, 1e-6, 2)
    scored = layer.fit(rows, ["row_id", "label", "fold", "origin"])
    assert scored.count() == rows.count() and all(hasattr(m, "stages") and not isinstance(m, B.FoldTrees) for m in layer.models.values())
