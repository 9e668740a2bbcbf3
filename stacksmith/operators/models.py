"""MLlib estimators by name, class weights, probability extraction, and the
model families built from them (ml01-ml16, fe06, fe11-fe15, ag18, ag19, ud03).

Models are fitted by MLlib on the cluster; only fitted parameters
(coefficients, trees, centres, PCA matrices: sizes fixed by the feature
count, not the row count) reach the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    IDF, PCA, HashingTF, Normalizer, OneHotEncoder, RegexTokenizer, StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- registry (ud03)

ESTIMATORS: dict[str, Callable[..., Estimator]] = {}
# Estimators that take a weight column; the others are balanced by undersampling.
WEIGHTED = {"logistic", "gbt", "random_forest", "naive_bayes"}


def register_estimator(name: str):
    def deco(factory):
        ESTIMATORS[name] = factory
        return factory
    return deco


@register_estimator("logistic")
def _lr(features="features", label="label", weight=None, **p):
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight or "",
                              maxIter=p.get("max_iter", 50), regParam=p.get("reg", 0.01),
                              elasticNetParam=p.get("l1_ratio", 0.0))


@register_estimator("gbt")
def _gbt(features="features", label="label", weight=None, **p):
    return GBTClassifier(featuresCol=features, labelCol=label, weightCol=weight or "",
                         maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 4),
                         stepSize=p.get("learning_rate", 0.1), subsamplingRate=p.get("subsample", 1.0),
                         maxBins=p.get("max_bins", 32), seed=p.get("seed", 42))


@register_estimator("random_forest")
def _rf(features="features", label="label", weight=None, **p):
    return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight or "",
                                  numTrees=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 6),
                                  seed=p.get("seed", 42))


@register_estimator("naive_bayes")
def _nb(features="features", label="label", weight=None, **p):
    return NaiveBayes(featuresCol=features, labelCol=label, weightCol=weight or "", modelType="gaussian")


@register_estimator("mlp")
def _mlp(features="features", label="label", weight=None, n_features: int = 0, **p):
    hidden = list(p.get("hidden", [16]))
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_features, *hidden, 2], maxIter=p.get("max_iter", 100),
                                          stepSize=p.get("learning_rate", 0.03), seed=p.get("seed", 42))


def make_estimator(name: str, params: dict | None = None, features="features", label="label",
                   weight: str | None = None, n_features: int = 0) -> Estimator:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(ESTIMATORS)}")
    w = weight if name in WEIGHTED else None
    return ESTIMATORS[name](features=features, label=label, weight=w, n_features=n_features, **(params or {}))


def scaled_pipeline(feature_cols: Sequence[str], est: Estimator, with_mean: bool = True) -> Pipeline:
    """Assemble -> standardise (fitted per training set: no leak) -> model."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(feature_cols), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=with_mean, withStd=True),
        est])


def proba_pos(col: str = "probability") -> Column:
    """P(class 1) from MLlib's probability vector."""
    return vector_to_array(F.col(col))[1]


def class_weights(df: DataFrame, label: str = "label", mode: str = "balanced", out: str = "weight") -> DataFrame:
    """ag13 as a column: 'balanced' n/(k n_c); 'neg_pos' positives weigh #neg/#pos.
    The per-class table has one row per class (broadcast)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    allw = Window.partitionBy()
    if mode == "balanced":
        w = F.sum("_n").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("_n"))
    elif mode == "neg_pos":
        neg = F.sum(F.when(F.col(label) == 0, F.col("_n"))).over(allw)
        pos = F.sum(F.when(F.col(label) == 1, F.col("_n"))).over(allw)
        w = F.when(F.col(label) == 1, neg / pos).otherwise(F.lit(1.0))
    else:
        raise ValueError(mode)
    table = per.select(label, w.cast("double").alias(out))
    return df.join(F.broadcast(table), label)


def score(model, df: DataFrame, keep: Sequence[str], out: str = "proba") -> DataFrame:
    return model.transform(df).select(*keep, proba_pos().alias(out))


# ---------------------------------------------------------------- importances (ml15)

def importances(model, names: Sequence[str]) -> DataFrame:
    """Feature importance table (trees: featureImportances; linear: |coef|)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.active()  # the default one in a thread of its own
    m = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    return spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")


# ---------------------------------------------------------------- ensembles (ml10, ml11)

def soft_vote(scored: Sequence[DataFrame], key: str = "row_id", proba: str = "proba") -> DataFrame:
    """ml11: equal-weight mean of member probabilities."""
    u = reduce(lambda a, b: a.unionByName(b), [s.select(key, proba) for s in scored])
    return u.groupBy(key).agg(F.avg(proba).alias(proba))


def random_subspace_lr(train: DataFrame, valid: DataFrame, feature_cols: Sequence[str], n_models: int,
                       k_min: int, k_max: int, seed: int = 42, power: float = 1.0, label: str = "label",
                       key: str = "row_id", metric: Callable[[DataFrame], float] | None = None):
    """ml10: members on seeded random feature subsets (drawn on the driver: a
    short list of column names); weight = metric(valid)^power, normalised,
    equal when all are zero.  Returns (members, weights) where a member is
    (columns, fitted pipeline)."""
    from stacksmith.functions.metrics import binary_report
    rng = random.Random(seed)
    metric = metric or (lambda d: binary_report(d, label, "proba").first()["f1"])
    members, scores_ = [], []
    for _ in range(n_models):
        k = rng.randint(k_min, min(k_max, len(feature_cols)))
        cols = sorted(rng.sample(list(feature_cols), k))
        model = scaled_pipeline(cols, make_estimator("logistic", label=label)).fit(train)
        members.append((cols, model))
        scores_.append(max(0.0, float(metric(score(model, valid, [key, label])))) ** power)
    tot = sum(scores_)
    weights = [s / tot for s in scores_] if tot > 0 else [1.0 / len(scores_)] * len(scores_)
    return members, weights


def predict_subspace(members, weights, df: DataFrame, key: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    parts = [score(m, df, [key]).withColumn("_w", F.lit(w)) for (_, m), w in zip(members, weights)]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    blend = u.groupBy(key).agg((F.sum(F.col("_w") * F.col("proba")) / F.sum("_w")).alias("proba"))
    return blend.join(df.select(key, *keep), key) if keep else blend


# ---------------------------------------------------------------- clustering (ml09, ml12-ml14, ml16, fe06, ag19)

def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42, max_iter: int = 20):
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster", maxIter=max_iter).fit(df)


def choose_k(df: DataFrame, ks: Sequence[int], features: str = "features", seed: int = 42) -> DataFrame:
    """ml13: inertia (elbow) and silhouette per k, one KMeans fit per k.
    MLlib's silhouette uses squared Euclidean distance."""
    from pyspark.sql import SparkSession
    rows = []
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="cluster", distanceMeasure="squaredEuclidean")
    for k in ks:
        m = kmeans(df, k, features, seed)
        rows.append((int(k), float(m.summary.trainingCost), float(ev.evaluate(m.transform(df)))))
    return SparkSession.getActiveSession().createDataFrame(rows, "k int, inertia double, silhouette double")


def distance_sums(model, df: DataFrame, features: str = "features") -> DataFrame:
    """ag19: per cluster, sum of distances and squared distances to the own
    centre (centres are k vectors, passed as a literal array)."""
    centers = [c.tolist() for c in model.clusterCenters()]
    arr = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    x = vector_to_array(F.col(features))
    c = F.element_at(arr, F.col("cluster") + 1)
    d2 = F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    t = model.transform(df).select("cluster", d2.alias("_d2"))
    return t.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.sqrt("_d2")).alias("sum_dist"),
                                    F.sum("_d2").alias("sum_sq_dist"))


def cluster_one_hot(model, df: DataFrame, prefix: str = "f99__text_cls") -> DataFrame:
    """fe06: cluster id of each row (its own, also for test rows) as 0/1 columns."""
    k = len(model.clusterCenters())
    t = model.transform(df)
    return t.select("*", *[(F.col("cluster") == j).cast("int").alias(f"{prefix}__{j}") for j in range(k)])


def gaussian_mixture(df: DataFrame, k: int, features: str = "features", seed: int = 42):
    """ml14."""
    return GaussianMixture(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)


def _by_cluster(train: DataFrame, cluster_features: str, k: int, label: str, seed: int):
    """KMeans fit, {cluster: (rows, positives)} of the training rows, and the training prior."""
    km = kmeans(train, k, cluster_features, seed)
    sizes = {r["cluster"]: (r["n"], r["npos"]) for r in
             km.transform(train).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("npos")).collect()}
    prior = float(sum(v[1] for v in sizes.values())) / max(1, sum(v[0] for v in sizes.values()))
    return km, sizes, prior


def cluster_then_classify(train: DataFrame, test: DataFrame, features: str, k: int, model_name: str,
                          label: str = "label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """ml09: KMeans on the (scaled) vectors, one classifier per cluster, rows
    routed by their cluster.  Rows of a cluster without both classes in
    training get the training prior."""
    km, sizes, prior = _by_cluster(train, features, k, label, seed)
    tr, te = km.transform(train), km.transform(test)
    parts = []
    for j in range(k):
        n, npos = sizes.get(j, (0, 0))
        part = te.filter(F.col("cluster") == j)
        if n == 0 or npos in (0, n):
            parts.append(part.select(key, F.lit(prior).alias("proba"), "cluster"))
            continue
        m = make_estimator(model_name, features=features, label=label).fit(tr.filter(F.col("cluster") == j))
        parts.append(m.transform(part).select(key, proba_pos().alias("proba"), "cluster"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def clustered_cv_vote(train: DataFrame, test: DataFrame, features: str, k: int, folds: int, model_name: str,
                      label: str = "label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """ml16: in every cluster of the vectors, folds of its own and one model a
    fold; each test row gets the rounded mean vote of its cluster's models.
    Clusters that cannot be split by class vote with the training prior."""
    from stacksmith.operators.sampling import stratified_kfold
    km, sizes, prior = _by_cluster(train, features, k, label, seed)
    tr, te = km.transform(train), km.transform(test)
    parts = []
    for j in range(k):
        n, npos = sizes.get(j, (0, 0))
        mine = te.filter(F.col("cluster") == j)
        if n == 0 or min(npos, n - npos) < folds:
            parts.append(mine.select(key, F.lit(int(prior > 0.5)).alias("pred")))
            continue
        own = stratified_kfold(tr.filter(F.col("cluster") == j).drop("cluster"), folds, seed, label, key=key)
        for i in range(folds):
            m = make_estimator(model_name, features=features, label=label).fit(own.filter(F.col("fold") != i))
            parts.append(m.transform(mine).select(key, (proba_pos() > 0.5).cast("int").alias("pred")))
    votes = reduce(lambda a, b: a.unionByName(b), parts)
    return votes.groupBy(key).agg(F.bround(F.avg("pred"), 0).cast("int").alias("pred"))


# ---------------------------------------------------------------- PCA and text (fe11-fe15)

def pca_pipeline(input_col: str, k: int, output_col: str = "pcs") -> Pipeline:
    """fe11/fe12/fe15: centre (MLlib's PCA transform does not), then project."""
    return Pipeline(stages=[StandardScaler(inputCol=input_col, outputCol="_centred", withMean=True, withStd=False),
                            PCA(k=k, inputCol="_centred", outputCol=output_col)])


def explained_variance(pca_model, names: Sequence[str] | None = None) -> DataFrame:
    """fe13: ratio and cumulative ratio per component (wn10: running sum over k rows)."""
    from pyspark.sql import SparkSession
    m = pca_model.stages[-1] if hasattr(pca_model, "stages") else pca_model
    ev = m.explainedVariance.toArray().tolist()
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)], "component int, ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum("ratio").over(w))


def loadings(pca_model, df: DataFrame, names: Sequence[str], scores: str = "pcs") -> DataFrame:
    """fe13: (feature, component, loading) with loading = component x sqrt(variance of the component's scores on ``df``)."""
    from pyspark.sql import SparkSession
    m = pca_model.stages[-1] if hasattr(pca_model, "stages") else pca_model
    pc = m.pc.toArray()
    arr = vector_to_array(F.col(scores))
    var = pca_model.transform(df).agg(*[F.var_samp(F.element_at(arr, j + 1)).alias(str(j)) for j in range(pc.shape[1])]).first()
    rows = [(names[i], j + 1, float(pc[i, j]) * math.sqrt(var[j] or 0.0)) for i in range(pc.shape[0]) for j in range(pc.shape[1])]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, component int, loading double")


#: Characters between words: all that is neither letter, digit nor underscore in any script.
WORD_GAPS = r"[^\p{L}\p{N}_]+"


def text_vectors(num_features: int = 1 << 18, min_df: float = 1.0) -> Pipeline:
    """fe14 (re-aimed): tokens -> hashed term counts -> IDF -> L2 normalise.

    ``num_features`` is the width of the hashed space; set it well above the
    number of distinct words where collisions matter.  ``tfidf_terms`` has none.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tok", pattern=WORD_GAPS, minTokenLength=1),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=int(min_df)),
        Normalizer(inputCol="_tfidf", outputCol="text_vec", p=2.0)])


def tfidf_terms(docs: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """fe14 in long form: (key, term, weight), L2-normalised TF-IDF over the fitted vocabulary of all documents.

    Term and document counts are partial aggregates; the document frequencies
    come back in an equi-join on the term, so no vocabulary reaches the driver.
    The counts are written once and read by both; the norm is a sum over the
    key's rows, so the weights are made and shuffled once.
    """
    from stacksmith.operators.rank import cut
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_GAPS), lambda w: w != "")
    tf = cut(docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "term-counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n_docs"))
    weighted = (tf.join(df, "term").withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
                .filter(F.col(key).isNotNull())
                .select(key, "term", (F.col("tf") * F.log((F.col("n_docs") + 1) / (F.col("df") + 1))).alias("w")))
    normed = weighted.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))))
    return normed.select(key, "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


#: Width of the dense text vectors, and bits that one digest of a term gives.
DENSE, DIGEST = 384, 128


def dense_text_vectors(docs: DataFrame, key: str = "row_id", text: str = "text", dims: int = DENSE, seed: str = "dense") -> DataFrame:
    """fe14: (key, vec), one L2-normalised vector of ``dims`` floats a document (``dims``: a multiple of 128).

    Seeded random indexing of the TF-IDF weights: bit j of the term's digests
    gives the sign with which its weight enters component j, so cosines of the
    vectors estimate those of the full TF-IDF vectors within about
    1 / sqrt(dims), no vocabulary is fitted or sent, and equal texts have equal
    vectors.  A document's terms meet in one row; Arrow batches are projected
    with numpy.  A text without words has the zero vector.
    """
    import numpy as np
    import pyarrow as pa
    if dims % DIGEST:
        raise ValueError(f"dims must be a multiple of {DIGEST}")
    terms = tfidf_terms(docs, key, text)
    bits = F.concat(*[F.unhex(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col("term")))) for i in range(dims // DIGEST)])
    # Sorted by term: the sums do not depend on the order of the shuffle.
    rows = terms.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "weight", bits.alias("bits")))).alias("t"))
    rows = docs.select(key).distinct().join(rows, key, "left").select(key, F.col("t.weight").alias("w"), F.col("t.bits").alias("b"))

    def project(batches):
        for batch in batches:
            out = np.zeros((len(batch), dims), np.float32)
            for i, (w, b) in enumerate(zip(batch.column(1), batch.column(2))):
                if w.is_valid and len(w):
                    signs = np.unpackbits(np.frombuffer(b"".join(b.values.to_pylist()), np.uint8)).reshape(len(w), dims)
                    v = w.values.to_numpy(zero_copy_only=False) @ (signs * 2.0 - 1.0)
                    out[i] = v / (np.linalg.norm(v) or 1.0)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dims)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[key, "vec"])

    return rows.mapInArrow(project, f"{key} {docs.schema[key].dataType.simpleString()}, vec array<float>")


def dense_from_array(col: str, out: str = "features") -> Column:
    return array_to_vector(F.col(col)).alias(out)


def one_hot_index(col_index: str, out: str) -> OneHotEncoder:
    return OneHotEncoder(inputCols=[col_index], outputCols=[out], dropLast=False, handleInvalid="keep")
