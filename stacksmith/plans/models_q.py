"""Model, clustering, PCA, text-vector, stacking, search and self-training
queries (rows-only checks: seeded MLlib fits cannot be replayed in SQL)."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from stacksmith.functions import scalars as S
from stacksmith.functions.metrics import confusion_sql, f1_sql, rounded
from stacksmith.operators import layered as LY
from stacksmith.operators import models as M
from stacksmith.operators import scores as SC
from stacksmith.operators import stacking as STK
from stacksmith.operators import wrapped  # noqa: F401  (registers its families)
from stacksmith.operators.profile import rate_table
from stacksmith.operators.sampling import stratified_holdout, stratified_kfold, undersample
from stacksmith.plans.eda import goal_usd
from stacksmith.plans.inputs import MODEL_STRENGTH, N_FOLDS, SEED, scores, with_ctes
from stacksmith.plans.registry import query
from stacksmith.sources import store as ST
from stacksmith.sources.tables import load

FEATS = ["f01__goal", "days_launch", "days_run", "days_state", "ad_ratio", "flag", "year_off"]
DAY = 86400.0


def model_frame(spark, sf):
    g = goal_usd(spark, sf)
    return g.select(
        "row_id", "split", "currency", F.col("final_status").cast("double").alias("label"), "f01__goal",
        ((F.col("launched_at") - F.col("created_at")) / DAY).alias("days_launch"),
        ((F.col("deadline") - F.col("launched_at")) / DAY).alias("days_run"),
        ((F.col("state_changed_at") - F.col("deadline")) / DAY).alias("days_state"),
        F.coalesce(S.ratio(F.col("launched_at") - F.col("created_at"), F.col("deadline") - F.col("created_at")),
                   F.lit(0.0)).alias("ad_ratio"),
        F.col("disable_communication").cast("double").alias("flag"),
        (F.year(S.ntz_from_epoch("created_at")) - 1995).cast("double").alias("year_off"))


def train_test(spark, sf, weights: str = "balanced"):
    # One join of the tables for both parts, and the folds move narrow rows that are already written.
    m = STK.materialize(model_frame(spark, sf), "model-frame")
    train = stratified_kfold(m.filter(F.col("split") == "train"), N_FOLDS, SEED, "label")
    train = M.class_weights(train, "label", weights, "weight")
    test = m.filter(F.col("split") == "test")
    # Every fit and score re-reads these: cut the join/rank lineage once
    # with a written table in the shared folder.
    return STK.materialize(train.drop("split"), "train"), STK.materialize(test.drop("split"), "test")


def fit_predict(name: str, params=None, weights="balanced", cols=FEATS):
    def run(spark, sf):
        train, test = train_test(spark, sf, weights)
        est = M.scaled_pipeline(cols, M.make_estimator(name, params, weight="weight", n_features=len(cols)))
        return M.score(est.fit(train), test, ["row_id", "label"])
    return run


query("ml01_logistic_regression")(fit_predict("logistic"))
query("ml02_gradient_boosted_trees")(fit_predict("gbt", {"n_estimators": 20, "max_depth": 4}, "neg_pos"))
query("ml04_random_forest")(fit_predict("random_forest", {"n_estimators": 20}))
query("ml08_gaussian_naive_bayes")(fit_predict("naive_bayes"))


@query("ml03_trees_with_categorical")
def ml03(spark, sf):
    train, test = train_test(spark, sf, "neg_pos")
    idx = StringIndexer(inputCol="currency", outputCol="currency_idx", handleInvalid="keep").fit(train)
    # The indexer's metadata marks this one column nominal; bins follow its fitted size.
    va = VectorAssembler(inputCols=FEATS + ["currency_idx"], outputCol="features")
    params = {"n_estimators": 20, "max_depth": 4, "max_bins": max(32, len(idx.labels) + 1)}
    model = M.make_estimator("gbt", params, weight="weight").fit(va.transform(idx.transform(train)))
    return model.transform(va.transform(idx.transform(test))).select("row_id", "label", M.proba_pos().alias("proba"))


@query("ml05_mlp_undersampled")
def ml05(spark, sf):
    train, test = train_test(spark, sf)
    bal = undersample(train, SEED, "label")
    est = M.scaled_pipeline(FEATS, M.make_estimator("mlp", {"hidden": [16], "max_iter": 60}, n_features=len(FEATS)))
    return M.score(est.fit(bal), test, ["row_id", "label"])


@query("ml06_mlp_with_categorical")
def ml06(spark, sf):
    train, test = train_test(spark, sf)
    bal = undersample(train, SEED, "label")
    idx = StringIndexer(inputCol="currency", outputCol="cur_idx", handleInvalid="keep").fit(bal)
    oh = M.one_hot_index("cur_idx", "cur_vec").fit(idx.transform(bal))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    prep = Pipeline(stages=[idx, oh, VectorAssembler(inputCols=FEATS + ["cur_vec"], outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(bal)
    tr = prep.transform(bal)
    n = tr.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or len(tr.select("features").first()[0])
    mlp = M.make_estimator("mlp", {"hidden": [16], "max_iter": 60}, n_features=int(n)).fit(tr)
    return mlp.transform(prep.transform(test)).select("row_id", "label", M.proba_pos().alias("proba"))


def _scaled_vectors(spark, sf):
    """Training and test rows of the embeddings, standardised on the training rows."""
    from pyspark.ml.feature import StandardScaler
    e = _emb_split(spark, sf)
    train, test = e.filter(~F.col("is_holdout")).drop("is_holdout"), e.filter(F.col("is_holdout")).drop("is_holdout")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
    return [STK.materialize(scaler.transform(d).select("row_id", F.col("scaled").alias("features"), "label"), n)
            for d, n in ((train, "vec-train"), (test, "vec-test"))]


@query("ml09_cluster_then_classify")
def ml09(spark, sf):
    train, test = _scaled_vectors(spark, sf)
    return M.cluster_then_classify(train, test, "features", 6, "logistic")


@query("ml10_random_subspace_lr")
def ml10(spark, sf):
    train, test = train_test(spark, sf)
    fit_part, valid = train.filter(F.col("fold") != 0), train.filter(F.col("fold") == 0)
    members, weights = M.random_subspace_lr(fit_part, valid, FEATS, 6, 2, 5, SEED)
    return M.predict_subspace(members, weights, test, keep=["label"])


@query("ml09_wrapped_models_out_of_fold")
def wrapped(spark, sf):
    """Out-of-fold scores of the families made of several models; each is fitted, saved and scored as one estimator.

    Every fold of the training rows is held out once; families have the members their estimators name.
    """
    train, test = train_test(spark, sf)
    names = ("cluster_then_classify", "random_subspace", "soft_voting")
    return STK.oof_family(train, test, {name: lambda name=name: M.scaled_pipeline(FEATS, M.make_estimator(name, weight="weight")) for name in names}, N_FOLDS)


def _members(spark, sf):
    train, test = train_test(spark, sf)
    fits = {}
    for name in ("logistic", "naive_bayes", "random_forest"):
        est = M.scaled_pipeline(FEATS, M.make_estimator(name, weight="weight"))
        fits[name] = M.score(est.fit(train), test, ["row_id"])
    return fits, test


@query("ml11_soft_voting")
def ml11(spark, sf):
    fits, test = _members(spark, sf)
    return M.soft_vote(list(fits.values())).join(test.select("row_id", "label"), "row_id")


def emb_frame(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), M.dense_from_array("embedding"),
                    (F.col("label") >= 5).cast("double").alias("label"))


@query("ml12_kmeans")
def ml12(spark, sf):
    e = emb_frame(spark, sf)
    return M.kmeans(e, 10).transform(e).select("row_id", "cluster")


@query("ml13_choose_k")
def ml13(spark, sf):
    return M.choose_k(emb_frame(spark, sf), [4, 8, 12])


@query("ml14_gaussian_mixture")
def ml14(spark, sf):
    e = emb_frame(spark, sf)
    pca = M.pca_pipeline("features", 8, "pcs").fit(e)
    z = pca.transform(e)
    gm = M.gaussian_mixture(z, 4, "pcs")
    return gm.transform(z).select("row_id", "cluster")


@query("ml15_feature_importances")
def ml15(spark, sf):
    train, _ = train_test(spark, sf, "neg_pos")
    m = M.scaled_pipeline(FEATS, M.make_estimator("gbt", {"n_estimators": 20}, weight="weight")).fit(train)
    return M.importances(m, FEATS)


@query("wn08_top_features")
def wn08(spark, sf):
    """The 100 most important of all built features, from the fold whose held-out F1 is best."""
    from stacksmith.operators.features import ProjectFeatures
    from stacksmith.plans.inputs import projects, rates_frame
    p = STK.materialize(projects(spark, sf).filter(F.col("split") == "train"), "train-projects")
    features = ProjectFeatures.fit(p, rates_frame(spark))
    names = features.feature_names()
    numbers = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]  # the ratio of equal times is null
    # Folds and weights before the features: their shuffles move the narrow project rows.
    own = ["label", "fold", "origin", "weight"]
    folded = stratified_kfold(p.withColumn("label", F.col("final_status").cast("double")), 5, SEED, "label")
    folded = M.class_weights(folded.withColumn("origin", F.lit("train")), "label", "neg_pos", "weight")
    rows = STK.materialize(features.transform(folded, True, own).select("row_id", *own, *numbers), "features")
    layer = LY.FoldedLayer("base", names, {"gbt": LY.FoldedTrees({"n_estimators": 10})}, 5, 1e-6, LY.SLOTS)
    layer.fit(rows, ["row_id", "label", "fold", "origin"])
    return LY.top_features(LY.importance_table(spark, [layer]), "base", "gbt", 100)


@query("ml16_clustered_cv_ensemble")
def ml16(spark, sf):
    train, test = _scaled_vectors(spark, sf)
    return M.clustered_cv_vote(train, test, "features", 3, 5, "logistic")


@query("fe14_text_vectors", """
WITH tf AS (SELECT doc_id AS row_id, term, count(*) AS tf
            FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT row_id, term, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w FROM tf JOIN df USING (term))
SELECT row_id, term, round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 6) AS weight
FROM w JOIN (SELECT row_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) USING (row_id)""")
def fe14(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return M.tfidf_terms(d).select("row_id", "term", F.round("weight", 6).alias("weight"))


@query("fe14_dense_text_vectors")
def fe14_dense(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return M.dense_text_vectors(d)


def _doc_clusters(spark, sf, k=6):
    """KMeans on the text vectors of all documents, labelled or not."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    tv = STK.materialize(M.text_vectors().fit(d).transform(d).select("row_id", "text_vec"), "text-vectors")
    return M.kmeans(tv, k, "text_vec"), tv


@query("fe06_cluster_one_hot")
def fe06(spark, sf):
    km, tv = _doc_clusters(spark, sf)
    return M.cluster_one_hot(km, tv).drop("text_vec", "cluster")


@query("ag18_cluster_label_rate")
def ag18(spark, sf):
    """Label rate by cluster: clusters come from all documents, rates from the labelled ones."""
    km, tv = _doc_clusters(spark, sf)
    lab = load(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("label"))
    return rate_table(km.transform(tv).select("row_id", "cluster").join(lab, "row_id"), "cluster", "label")


@query("ag19_cluster_distance_sums")
def ag19(spark, sf):
    e = emb_frame(spark, sf)
    return M.distance_sums(M.kmeans(e, 10), e)


def _emb_split(spark, sf):
    e = emb_frame(spark, sf)
    return stratified_holdout(e, 0.25, SEED, "label")


@query("fe11_pca_text_vectors")
def fe11(spark, sf):
    e = _emb_split(spark, sf)
    pca = M.pca_pipeline("features", 8, "pcs").fit(e.filter(~F.col("is_holdout")))
    z = pca.transform(e)
    return z.select("row_id", *[F.round(F.element_at(M.vector_to_array("pcs"), i + 1), 6).alias(f"pc{i + 1}") for i in range(8)])


@query("fe13_explained_variance")
def fe13(spark, sf):
    pca = M.pca_pipeline("features", 16, "pcs").fit(emb_frame(spark, sf))
    return M.explained_variance(pca)


@query("fe13_loadings")
def fe13_loadings(spark, sf):
    e = emb_frame(spark, sf)
    pca = M.pca_pipeline("features", 16, "pcs").fit(e)
    names = [f"f06__{i + 1:03d}__SentenceVec" for i in range(pca.stages[-1].pc.numRows)]
    return M.loadings(pca, e, names)


@query("fe15_pca3_compression")
def fe15(spark, sf):
    e = _emb_split(spark, sf)
    pca = M.pca_pipeline("features", 3, "pcs").fit(e.filter(~F.col("is_holdout")))
    arr = M.vector_to_array("pcs")
    return pca.transform(e).select("row_id", *[F.element_at(arr, i + 1).alias(f"f98__umap_{i + 1}") for i in range(3)])


@query("fe12_pca_meta_features")
def fe12(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "train")
    models = list(MODEL_STRENGTH)
    wide = s.groupBy("row_id").pivot("model_id", models).agg(F.first("proba"))
    va = VectorAssembler(inputCols=models, outputCol="meta")
    z = va.transform(wide)
    pca = M.pca_pipeline("meta", 2, "pcs").fit(z)
    arr = M.vector_to_array("pcs")
    return pca.transform(z).select("row_id", *[F.element_at(arr, i + 1).alias(f"MetaFeatsPC_{i + 1}") for i in range(2)])


# ---------------------------------------------------------------- stacking and evaluation

def lr_factory(cols=FEATS, name="logistic", params=None):
    return lambda: M.scaled_pipeline(cols, M.make_estimator(name, params, weight="weight", n_features=len(cols)))


@query("ev01_oof_scores")
def ev01(spark, sf):
    train, test = train_test(spark, sf)
    return STK.oof_scores(train, test, "logistic", lr_factory(), 5)


@query("ev04_stack_v1")
def ev04(spark, sf):
    train, _ = train_test(spark, sf)
    base = {"lr": lr_factory(), "nb": lr_factory(name="naive_bayes")}
    return STK.stack_v1(train, FEATS, base, 5)


def _holdout_parts(spark, sf):
    train, _ = train_test(spark, sf)
    # Written: every fit and score reads these rows.
    h = STK.materialize(stratified_holdout(train.drop("fold"), 0.2, SEED, "label"), "holdout")
    tr = stratified_kfold(h.filter(~F.col("is_holdout")).drop("is_holdout"), 5, SEED, "label")
    ho = h.filter(F.col("is_holdout")).drop("is_holdout")
    return STK.materialize(tr, "holdout-train"), ho


@query("ev05_stack_v2_leak_free")
def ev05(spark, sf):
    tr, ho = _holdout_parts(spark, sf)
    base = {"lr": lr_factory(), "nb": lr_factory(name="naive_bayes")}
    return STK.stack_v2(tr, ho, FEATS, base, 5, 2)


BASE = {"lr": LY.model_on("logistic"), "nb": LY.model_on("naive_bayes")}
METAS = {"lr": LY.model_on("logistic"), "rf": LY.model_on("random_forest", {"n_estimators": 10, "max_depth": 4})}


@query("ev06_multi_meta_blend")
def ev06(spark, sf):
    """Base out-of-fold scores, their components, two metas on features and components, weighted blend of the hold-out."""
    tr, ho = _holdout_parts(spark, sf)
    model = LY.fit_layered_stack(tr, BASE, METAS, FEATS, k=5)
    return model.transform(ho).select("row_id", "label", *[f"{m}__meta" for m in METAS], "proba", "pred")


@query("ev08_top_k_feature_member")
def ev08(spark, sf):
    train, test = train_test(spark, sf)
    return STK.top_k_feature_member(train, test, FEATS, 4, 5)[0]


def _pseudo_stack(spark, sf):
    """(stack fitted on train and pseudo rows, test rows that are no pseudo rows)."""
    train, test = train_test(spark, sf)
    pick = SC.mean_score(scores(spark, sf, "test"), ["row_id"], out="p")
    pseudo = (pick.filter("p < 0.3 or p > 0.7").select("row_id", (F.col("p") > 0.5).cast("double").alias("label"))
              .join(test.drop("label"), "row_id"))
    pseudo = STK.materialize(pseudo, "pseudo-rows")
    rest = test.join(pseudo.select("row_id"), "row_id", "left_anti")
    return LY.fit_layered_stack(train, BASE, METAS, FEATS, pseudo, k=5, class_weight="neg_pos"), rest


@query("ev09_stack_with_pseudo_rows")
def ev09(spark, sf):
    """Out-of-fold scores of train and pseudo rows by fold, and the scores of the other test rows."""
    model, rest = _pseudo_stack(spark, sf)
    cols = ["row_id", "origin", "fold", "label", "proba", "pred"]
    tested = model.transform(rest.withColumn("origin", F.lit("test")).withColumn("fold", F.lit(None).cast("int")))
    return model.out_of_fold().select(cols).unionByName(tested.select(cols))


@query("ev09_f1_by_origin")
def ev09_f1(spark, sf):
    return _pseudo_stack(spark, sf)[0].f1_by_origin()


@query("ev15_validation_curve")
def ev15(spark, sf):
    train, _ = train_test(spark, sf)
    t3 = stratified_kfold(train.drop("fold"), 3, SEED, "label").withColumnRenamed("fold", "fold3")
    return STK.validation_curve(t3, "logistic", "reg", [0.001, 0.1, 1.0], FEATS, 3)


@query("ev16_random_search_continuous")
def ev16(spark, sf):
    train, _ = train_test(spark, sf)
    settings = STK.draw_settings({"reg": (1e-4, 1.0, "log", 6), "max_iter": (10, 60, "int")}, 3, SEED)
    return STK.run_experiments(train, FEATS, [("logistic", s) for s in settings], 5)


@query("ev17_random_search_discrete")
def ev17(spark, sf):
    train, _ = train_test(spark, sf)
    draws = STK.draw_discrete({"cluster_then_classify": {"k": [2, 3, 4], "model": ["logistic", "naive_bayes"]},
                               "random_subspace": {"members": [3, 4], "power": [1.0, 4.0]},
                               "random_forest": {"max_depth": [3, 5], "n_estimators": [10]}}, 3, SEED)
    return STK.run_experiments(train, FEATS, draws, 5)


@query("ev18_run_experiments_logged")
def ev18(spark, sf):
    train, _ = train_test(spark, sf)
    runs = STK.run_experiments(train, FEATS, [("logistic", {"reg": 0.01}), ("naive_bayes", {})], 5)
    log = ST.RunLog(spark, ST.fresh_path(spark, "experiments"))
    log.append(runs.select("run_id", "model", "params", F.create_map(F.lit("f1"), F.col("cv_score")).alias("metrics")))
    return log.read().drop("source_file")


@query("ev20_pluggable_metric", with_ctes(f"""
SELECT metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT CAST({{f1}} AS DOUBLE) AS f1, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
                  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
                  CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, CAST(auc AS DOUBLE) AS auc, CAST({{g1}} AS DOUBLE) AS "f1_at_0.6"
           FROM (SELECT {confusion_sql('y', 'CAST(proba > 0.5 AS INTEGER)')},
                        sum(CASE WHEN y = 1 AND proba > 0.6 THEN 1 ELSE 0 END) AS t6, sum(CASE WHEN proba > 0.6 THEN 1 ELSE 0 END) AS p6,
                        (sum(CASE WHEN y = 1 THEN ar ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc
                 FROM (SELECT final_status AS y, proba, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0 AS ar
                       FROM scores WHERE split = 'train' AND model_id = 'm3') r) c)
  ON COLUMNS(*) INTO NAME metric VALUE value) u""".format(f1=f1_sql(), g1="CASE WHEN p6 + tp + fn = 0 THEN 0.0 ELSE 2.0 * t6 / (p6 + tp + fn) END"), "scores"))
def ev20(spark, sf):
    s = scores(spark, sf).filter((F.col("split") == "train") & (F.col("model_id") == "m3"))
    s = s.select(F.col("final_status").alias("label"), "proba")
    at_06 = lambda y, p: STK.METRICS["f1"](y, p, 0.6)
    return rounded(STK.metric_table(s, {**STK.METRICS, "f1_at_0.6": at_06}))


def _self_train(spark, sf, **kw):
    """Self-training on the embeddings, whose label the vectors carry: two members, soft vote."""
    train, test = _scaled_vectors(spark, sf)
    model = lambda name, **p: (lambda: M.make_estimator(name, p, weight="weight"))
    return STK.self_training(train, test, {"lr": model("logistic", reg=0.001), "nb": model("naive_bayes")}, k=3, **kw)


#: Both classes grow over several steps on these vectors; a step without F1 gain does not end the run at once.
PL02 = {"max_steps": 4, "pos_base": 0.8, "growth": 1.05, "neg_threshold": 0.2, "ratio": 4, "patience": 3}


@query("pl02_self_training_added_rows")
def pl02(spark, sf):
    return _self_train(spark, sf, **PL02)[0]


@query("pl08_self_training_step_log")
def pl08(spark, sf):
    return _self_train(spark, sf, **PL02)[1]


@query("pl05_pool_self_training")
def pl05(spark, sf):
    """Pool variant with a threshold schedule; the last rows compare models before and after, refitted on train and added rows."""
    train, test = _scaled_vectors(spark, sf)
    model = lambda: M.make_estimator("logistic", weight="weight")
    added, _ = STK.self_training(train, test, {"lr": model}, k=3, max_steps=3, pos_schedule=[0.8, 0.75, 0.7], neg_threshold=0.25,
                                 ratio=5, patience=2)
    rest = test.join(added.select("row_id"), "row_id", "left_anti")
    more = train.unionByName(added.drop("step").join(test.drop("label"), "row_id").select(train.columns))
    return rounded(STK.before_after({"before": train, "after": more}, rest, model))


# ---------------------------------------------------------------- exact KNN (jn09, ml07)

from stacksmith.functions.seeded import seeded_key_sql  # noqa: E402
from stacksmith.operators.knn import knn_classify, knn_join  # noqa: E402

K_NEIGHBOURS = 141


def _knn_sides(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"),
                                             (F.col("label") >= 5).cast("double").alias("label"))
    e = stratified_holdout(e, 0.25, SEED, "label", key="vec_id")
    q = e.filter(F.col("is_holdout")).select(F.col("vec_id").alias("qid"), "vec")
    r = e.filter(~F.col("is_holdout")).select(F.col("vec_id").alias("rid"), "vec", "label")
    return q, r


_KNN_BASE = f"""
WITH e AS (SELECT vec_id, embedding, CAST(label >= 5 AS DOUBLE) AS label,
             row_number() OVER (PARTITION BY label >= 5 ORDER BY {seeded_key_sql(SEED, 'vec_id')}, vec_id)
               <= round(count(*) OVER (PARTITION BY label >= 5) * 0.25) AS is_holdout
           FROM embeddings),
 pairs AS (
   SELECT q.vec_id AS qid, r.vec_id AS rid, r.label,
          list_reduce(list_transform(list_zip(q.embedding, r.embedding),
                      lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))),
                      lambda a, b: a + b) AS d2
   FROM (SELECT * FROM e WHERE is_holdout) q, (SELECT * FROM e WHERE NOT is_holdout) r),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rk FROM pairs)
"""


@query("jn09_exact_knn_join", _KNN_BASE + f"SELECT qid, rid, CAST(rk AS INTEGER) AS rank FROM ranked WHERE rk <= {K_NEIGHBOURS}")
def jn09(spark, sf):
    q, r = _knn_sides(spark, sf)
    return knn_join(q, r, K_NEIGHBOURS).select("qid", "rid", F.col("rank").cast("int").alias("rank"))


_KNN_SCALED = f"""
WITH e AS (SELECT vec_id, embedding, CAST(label >= 5 AS DOUBLE) AS label, {seeded_key_sql(SEED, 'vec_id')} AS sk,
             row_number() OVER (PARTITION BY label >= 5 ORDER BY {seeded_key_sql(SEED, 'vec_id')}, vec_id)
               <= round(count(*) OVER (PARTITION BY label >= 5) * 0.25) AS is_holdout
           FROM embeddings),
 sizes AS (SELECT label, count(*) AS n FROM e WHERE NOT is_holdout GROUP BY 1),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sk, vec_id) AS rk FROM e WHERE NOT is_holdout)
       WHERE rk <= (SELECT min(n) FROM sizes)),
 dims AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s
          FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM u) GROUP BY 1),
 st AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS s FROM dims),
 sc AS (SELECT vec_id, label, is_holdout, list_transform(list_zip(embedding, m, s), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) / x[3]) AS v
        FROM (SELECT vec_id, label, is_holdout, embedding FROM u UNION ALL SELECT vec_id, label, is_holdout, embedding FROM e WHERE is_holdout), st),
 pairs AS (
   SELECT q.vec_id AS qid, r.vec_id AS rid, r.label,
          list_reduce(list_transform(list_zip(q.v, r.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b) AS d2
   FROM (SELECT * FROM sc WHERE is_holdout) q, (SELECT * FROM sc WHERE NOT is_holdout) r),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rk FROM pairs)
SELECT qid, round(avg(label), 6) AS proba FROM ranked WHERE rk <= {K_NEIGHBOURS} GROUP BY qid"""


@query("ml07_knn_classifier", _KNN_SCALED)
def ml07(spark, sf):
    """Neighbours among undersampled reference rows, all vectors scaled by those rows."""
    from stacksmith.operators.features import standardised_arrays
    q, r = _knn_sides(spark, sf)
    r = STK.materialize(undersample(r, SEED, "label", "rid"), "balanced")
    q, r = standardised_arrays(r, "vec", q, r)
    return knn_classify(q, r, K_NEIGHBOURS).select("qid", F.round("proba", 6).alias("proba"))


@query("wn10_cumulative_explained_variance")
def wn10(spark, sf):
    return fe13(spark, sf).select("component", "cumulative")


@query("so05_schema_equality")
def so05(spark, sf):
    """Train and test feature frames must share the fitted schema."""
    from stacksmith.operators.features import ProjectFeatures
    from stacksmith.plans.inputs import projects, rates_frame
    p = projects(spark, sf)
    train, test = p.filter(F.col("split") == "train"), p.filter(F.col("split") == "test")
    model = ProjectFeatures.fit(train, rates_frame(spark))
    tr, te = model.transform(train, True), model.transform(test, False)
    same = sorted(tr.columns) == sorted(te.columns) and tr.schema == te.schema
    return spark.createDataFrame([(len(tr.columns), same)], "n_columns int, same_columns boolean")


@query("pl04_stop_rules")
def pl04(spark, sf):
    """The stop rule over a step log, as window expressions: stop after a step
    without F1 gain (patience 1) or after two consecutive empty steps."""
    from pyspark.sql import Window
    steps = pl08(spark, sf)
    w = Window.orderBy("step")
    best_before = F.max("cv_f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    empty = (F.col("added_pos") + F.col("added_neg")) == 0
    prev_empty = F.lag(empty.cast("int"), 1, 0).over(w) == 1
    return steps.select("step", "cv_f1", (F.col("cv_f1") <= F.coalesce(best_before, F.lit(-1.0))).alias("no_gain"),
                        (empty & prev_empty).alias("two_empty"))


@query("ud02_callable_metric", with_ctes(f"""
SELECT model_id, round((CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END + CAST(tn AS DOUBLE) / (tn + fp)) / 2, 6) AS balanced_accuracy
FROM (SELECT model_id, {confusion_sql('final_status', 'CAST(proba > 0.5 AS INTEGER)')} FROM scores WHERE split = 'train' GROUP BY 1) c""", "scores"))
def ud02(spark, sf):
    """A metric given as a callable (label, proba) -> aggregate, for all base models in one aggregation."""
    def balanced(y, p):
        hit = lambda c: F.avg(F.when(y == c, ((p > 0.5).cast("int") == c).cast("double")))
        return (hit(1) + hit(0)) / 2
    s = scores(spark, sf).filter(F.col("split") == "train")
    return rounded(s.groupBy("model_id").agg(balanced(F.col("final_status"), F.col("proba")).alias("balanced_accuracy")))


@M.register_estimator("user_ridge_logistic")
def _user_lr(features="features", label="label", weight=None, **p):
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=p.get("reg", 1.0), elasticNetParam=0.0)


@query("ud03_user_estimator")
def ud03(spark, sf):
    """A user-registered estimator name used by the OOF machinery like a built-in one."""
    train, test = train_test(spark, sf)
    return STK.oof_scores(train, test, "user", lr_factory(name="user_ridge_logistic"), 3)
