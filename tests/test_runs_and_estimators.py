"""Run records, reuse by fingerprint, stored schemas, sparse one-hot and wrapped estimators."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from stacksmith.operators import models as M
from stacksmith.operators import stacking as STK
from stacksmith.operators import wrapped as W
from stacksmith.operators.schema import FittedSchema
from stacksmith.operators.sparse import SparseFeatures, entries
from stacksmith.session import scratch_dir
from stacksmith.sources.runs import ResultStore, RunStore, fingerprint

COLS = ["a", "b", "c"]


def test_runs_are_replaced_not_doubled(spark):
    store = RunStore(spark, scratch_dir(spark, "t-runs"))
    first = spark.createDataFrame([("r1", 0.5), ("r2", 0.6)], "run_id string, f1 double").select("run_id", F.create_map(F.lit("f1"), "f1").alias("metrics"))
    store.put(first)
    store.put(first.filter("run_id = 'r2'").withColumn("metrics", F.create_map(F.lit("f1"), F.lit(0.7))))
    assert sorted((r.run_id, r.name, r.value) for r in store.facts().collect()) == [("r1", "f1", 0.5), ("r2", "f1", 0.7)]
    assert store.read().filter("importances is null and flags is null").count() == 2


def test_fingerprint_knows_rows_not_their_order(spark):
    rows = [(1, None, "x"), (2, "y", None), (2, "y", None)]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    same = [df.repartition(5, "id"), df.select("t", "id", "s"), df.orderBy(F.desc("id"))]
    assert {fingerprint(d, {"p": 1}) for d in [df, *same]} == {fingerprint(df, {"p": 1})}
    other = [df.distinct(), df.withColumn("id", F.col("id").cast("long")), df.filter("id > 5"),
             spark.createDataFrame([(1, None, "x"), (2, None, "y"), (2, "y", None)], df.schema)]
    assert len({fingerprint(d, {"p": 1}) for d in [df, *other]} | {fingerprint(df, {"p": 2})}) == 6


def test_result_computed_once_and_again_after_a_broken_write(spark):
    path = scratch_dir(spark, "t-results")
    df, calls = spark.range(10), []

    def compute(d, params):
        calls.append(1)
        return d.withColumn("x", F.col("id") * params["k"])
    store = ResultStore(spark, path)
    store.get_or_compute("m", df, {"k": 2}, compute)
    assert store.get_or_compute("m", df.repartition(3), {"k": 2}, compute).agg(F.sum("x")).first()[0] == 90 and len(calls) == 1
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/m/{fingerprint(df, {'k': 2})}/_SUCCESS")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
    assert store.get_or_compute("m", df, {"k": 2}, compute).count() == 10 and len(calls) == 2


def test_schema_differences(spark):
    fitted = FittedSchema.fit(spark.createDataFrame([], "a int, b double, c string"), scratch_dir(spark, "t-schema"))
    found = spark.createDataFrame([], "c string, b string, d int")
    assert sorted(map(tuple, fitted.differences(found).collect()), key=str) == [("a", "missing", "int", None), ("b", "retyped", "double", "string"), ("d", "extra", None, "int")]
    fitted.check(spark.createDataFrame([], "c string, a int, b double"))
    with pytest.raises(ValueError, match="missing: a"):
        fitted.check(found)


def test_sparse_one_hot_of_100_000_categories(spark):
    train = spark.range(100_000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), "id").alias("cat"), (F.col("id") % 3).cast("string").alias("few"), F.lit(None).cast("string").alias("none"),
                                        F.col("id").cast("double").alias("x"))
    model = SparseFeatures.fit(train, ["x"], {c: F.col(c) for c in ("cat", "few", "none")})
    assert model.size == 100_004 and model.names().count() == 100_004
    probe = spark.createDataFrame([(1, "v7", "0", 2.0, 9), (2, "unseen", "2", 0.0, 9), (3, None, None, None, 9)], "row_id long, cat string, few string, x double, value int").withColumn("none", F.lit("z"))
    out = model.transform(probe)
    assert out.columns == probe.columns + ["features"]
    name = {r.position: r.name for r in model.names().collect()}
    got = {(r.row_id, name[r.position]): r.v for r in out.select("row_id", F.explode(entries("features")).alias("e")).select("row_id", "e.position", F.col("e.value").alias("v")).collect()}
    assert {k for k in got} == {(1, "x"), (1, "cat__v7"), (1, "few__0"), (2, "few__2"), (3, "x")}
    assert got[1, "x"] == 2.0 and got[1, "cat__v7"] == 1.0 and np.isnan(got[3, "x"])
    assert {r.features.size for r in out.select("features").collect()} == {100_004}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    x[150:, 0] += 6
    # The label follows b in one cluster and its opposite in the other.
    y = np.where(x[:, 0] > 3, x[:, 1] > 0, x[:, 1] < 0).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i]), i % 2, "z") for i in range(300)], "row_id long, label double, a double, b double, c double, fold int, cluster string")
    return STK.materialize(df, "t-wrapped")


def _f1(df):
    return STK.evaluate(df.select("label", M.proba_pos().alias("proba")), "f1")


@pytest.mark.parametrize("name,params", [("cluster_then_classify", {"k": 2}), ("random_subspace", {"members": 3, "least": 1, "most": 2}), ("soft_voting", {"models": ["logistic", "naive_bayes"]})])
def test_estimators_save_load_copy_and_keep_rows(spark, rows, name, params):
    est = M.scaled_pipeline(COLS, M.make_estimator(name, params))
    path = scratch_dir(spark, f"t-{name}")
    est.write().save(f"{path}/est")
    model = Pipeline.load(f"{path}/est").fit(rows)
    model.write().save(f"{path}/model")
    again = PipelineModel.load(f"{path}/model")
    take = lambda m: {r.row_id: r.p for r in m.transform(rows).select("row_id", M.proba_pos().alias("p")).collect()}
    one = take(model)
    assert len(one) == 300 and all(0 <= p <= 1 for p in one.values()) and one == take(again)
    assert model.transform(rows.limit(0)).count() == 0
    renamed = est.getStages()[-1].copy({est.getStages()[-1].probabilityCol: "p2"})
    assert "p2" in Pipeline(stages=[*est.getStages()[:-1], renamed]).fit(rows).transform(rows).columns


def test_cluster_classifier_beats_one_model_and_uses_the_prior(spark, rows):
    one = M.scaled_pipeline(COLS, M.make_estimator("logistic")).fit(rows).transform(rows)
    many = M.scaled_pipeline(COLS, M.make_estimator("cluster_then_classify", {"k": 2})).fit(rows).transform(rows)
    assert _f1(many) > 0.95 > _f1(one) + 0.1
    flat = rows.withColumn("label", F.when(F.col("a") > 3, 1.0).otherwise(F.col("label")))
    model = M.scaled_pipeline(COLS, M.make_estimator("cluster_then_classify", {"k": 2})).fit(flat)
    prior = flat.agg(F.avg("label")).first()[0]
    got = {round(r.p, 9) for r in model.transform(flat.filter("a > 3")).select(M.proba_pos().alias("p")).collect()}
    assert got == {round(prior, 9)}


def test_subspace_weights_follow_the_held_part(spark, rows):
    easy = rows.withColumn("label", (F.col("c") > 0).cast("double"))
    model = M.scaled_pipeline(COLS, M.make_estimator("random_subspace", {"members": 6, "least": 1, "most": 1, "power": 4.0})).fit(easy).stages[-1]
    state = model.state
    with_c = sum(w for w, p in zip(state["weights"], state["picks"]) if 2 in p)
    assert abs(sum(state["weights"]) - 1) < 1e-9 and (with_c > 0.7 or not any(2 in p for p in state["picks"]))


def test_families_out_of_fold(spark, rows):
    oof = STK.oof_scores(rows, None, "wrapped", lambda: M.scaled_pipeline(COLS, M.make_estimator("cluster_then_classify", {"k": 2})), 2)
    assert oof.count() == 300 and STK.evaluate(oof, "f1") > 0.9
