"""Three-layer stack, parallel fits and resumable self-training."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml import Estimator, Model
from pyspark.sql import functions as F

from stacksmith.operators import layered as LY
from stacksmith.operators import models as M
from stacksmith.operators import stacking as STK
from stacksmith.operators.parallel import in_parallel

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=240) > 0).astype(float)
    data = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1]), "z") for i in range(240)]
    df = spark.createDataFrame(data, "row_id long, label double, a double, b double, other string")
    return STK.materialize(df.filter("row_id < 160"), "t-train"), STK.materialize(df.filter("row_id >= 200"), "t-test"), STK.materialize(df.filter("row_id between 160 and 199"), "t-added")


class _Memory(Model):
    """Scores a row 1 if it was among the fitted rows, by its unique value of ``a``."""

    def __init__(self, seen):
        super().__init__()
        self.seen, self.stages = seen, [self]

    def _transform(self, df):
        hit = F.col("a").isin(self.seen).cast("double")
        return df.withColumn("probability", M.array_to_vector(F.array(1 - hit, hit)))


class _Memorise(Estimator):
    def _fit(self, df):
        return _Memory([r["a"] for r in df.select("a").collect()])


def test_no_row_is_scored_by_a_model_that_saw_it(rows):
    train, test, added = rows
    spy = {"spy": lambda cols: _Memorise()}
    layer = LY.FoldedLayer("s", COLS, spy, 4, 1e-6, 2)
    folds = STK.stratified_kfold(train.unionByName(added).withColumn("origin", F.lit("train")).withColumn("weight", F.lit(1.0)), 4, 1, "label")
    scored = layer.fit(STK.materialize(folds, "t-folds"))
    assert scored.count() == 200 and scored.agg(F.max("spy__s")).first()[0] == 0.0
    # The models themselves do tell rows they saw from rows they did not.
    assert layer.score(train).agg(F.min("spy__s")).first()[0] > 0.5 and layer.score(test).agg(F.max("spy__s")).first()[0] == 0.0


def test_stack_with_pseudo_rows(rows):
    train, test, added = rows
    base = {"lr": LY.model_on("logistic"), "nb": LY.model_on("naive_bayes")}
    metas = {"lr": LY.model_on("logistic"), "rf": LY.model_on("random_forest", {"n_estimators": 5, "max_depth": 3})}
    model = LY.fit_layered_stack(train, base, metas, COLS, added, k=3)
    oof = model.out_of_fold().collect()
    assert sorted(r.row_id for r in oof) == list(range(200))
    assert {r.row_id for r in oof if r.origin == "pseudo"} == set(range(160, 200))
    for origin in ("train", "pseudo"):  # folds are paired: each origin is dealt over all of them
        sizes = [sum(r.fold == i and r.origin == origin for r in oof) for i in range(3)]
        assert max(sizes) - min(sizes) <= 2
    assert abs(sum(model.weights.values()) - 1) < 1e-12 and set(model.weights) == {"lr", "rf"}
    for r in oof:
        assert abs(r.proba - sum(w * r[f"{m}__meta"] for m, w in model.weights.items())) < 1e-12 and r.pred == (r.proba > 0.5)
    # F1 by origin and fold against a plain count.
    table = {(r.origin, r.fold): (r.n, r.f1) for r in model.f1_by_origin().collect()}
    assert len(table) == 8
    for (origin, fold), (n, f1) in table.items():
        part = [r for r in oof if r.origin == origin and fold in (None, r.fold)]
        tp = sum(r.pred and r.label for r in part)
        wrong = sum(r.pred != r.label for r in part)
        assert n == len(part) and f1 == pytest.approx(2 * tp / (2 * tp + wrong), abs=1e-5)
    # Any frame with the features is scored, its other columns kept; components are centred on the fitted rows.
    scored = model.transform(test)
    assert scored.count() == 40 and set(test.columns) <= set(scored.columns)
    hits = scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert hits > 0.7
    assert abs(model.oof.agg(F.avg("MetaFeatsPC_1")).first()[0]) < 1e-9
    best = LY.top_features(model.importances(), "meta", "rf", 3).collect()
    f1 = model.meta.f1
    assert [r["rank"] for r in best] == [1, 2, 3] and f1["rf", best[0].fold] == max(f1["rf", i] for i in range(3))
    assert [r.importance for r in best] == sorted((r.importance for r in best), reverse=True)


def test_parallel_results_keep_their_order_and_bound(spark):
    running, most, lock = [0], [0], threading.Lock()

    def task(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        n = spark.range(i).count()
        with lock:
            running[0] -= 1
        return n

    assert in_parallel(spark, [lambda i=i: task(i) for i in range(9)], 3) == list(range(9)) and 1 < most[0] <= 3

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        in_parallel(spark, [fails, lambda: 1], 2)


def test_curve_is_the_same_one_at_a_time(rows):
    train, _, _ = rows
    data = M.class_weights(STK.stratified_kfold(train, 3, 1, "label"), "label").withColumnRenamed("fold", "fold3")
    curve = lambda slots: sorted(map(tuple, STK.validation_curve(data, "logistic", "reg", [0.01, 1.0], COLS, 3, slots=slots).collect()))
    assert curve(1) == curve(4)


def test_self_training_grows_and_resumes(spark, rows, tmp_path):
    train, test, added = rows
    train = train.filter("row_id < 60")
    test = test.unionByName(added)
    fits = []

    def member():
        fits.append(1)
        return M.scaled_pipeline(COLS, M.make_estimator("logistic", {"reg": 0.001}, weight="weight"))

    run = lambda steps, store: STK.self_training(train.select("row_id", "label", *COLS), test.select("row_id", "label", *COLS), {"lr": member}, k=2,
                                                 max_steps=steps, pos_base=0.7, growth=1.02, neg_threshold=0.3, ratio=1, patience=9, store=store)
    whole, log = run(3, str(tmp_path / "whole"))
    steps = log.orderBy("step").collect()
    assert sum(r.added_pos > 0 for r in steps) >= 1 and [r.step for r in steps] == list(range(len(steps)))
    got = whole.collect()
    assert len({r.row_id for r in got}) == len(got) == steps[-1].added_cumulative
    assert all(r.added_neg <= r.added_pos for r in steps)
    # Interrupted after the first step: the rerun fits only what is left and ends with the same rows.
    part = str(tmp_path / "part")
    run(1, part)
    before = len(fits)
    resumed, log2 = run(3, part)
    assert len(fits) - before == 2 * (len(steps) - 1)
    assert sorted(map(tuple, resumed.collect())) == sorted(map(tuple, got)) and sorted(map(tuple, log2.collect())) == sorted(map(tuple, steps))
    before = len(fits)
    run(3, part)
    assert len(fits) == before
