"""Out-of-fold scoring, stacking, searches and self-training loops
(ev01, ev04, ev05, ev08, ev15-ev18, ev20, pl02, pl05, pl08); the three-layer
stack (ev06, ev09) is in ``stacksmith.operators.layered``.

The driver only loops over folds, models, settings or steps (short lists);
each fit/transform is a set of Spark jobs.  The hand-over between layers is
the long score table ``(row_id, split, model_id, fold, proba, label)``,
written to the shared folder (a lineage cut that survives executor loss).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.operators import boosted as B
from stacksmith.operators import models as M
from stacksmith.operators import scores as SC
from stacksmith.operators.parallel import SLOTS, in_parallel
from stacksmith.operators.sampling import stratified_kfold
from stacksmith.operators.selftrain import StopState, select_step, should_stop
from stacksmith.session import scratch_dir

ModelFactory = Callable[[], Estimator]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back (lineage cut)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- ev01 / ev02 / ev03

def _fold_fits(data: DataFrame, make_model: ModelFactory, k: int, fold_col: str) -> list[Callable]:
    """One fit a fold, on the rows of the others."""
    return [lambda i=i: make_model().fit(data.filter(F.col(fold_col) != i)) for i in range(k)]


def oof_scores(data: DataFrame, test: DataFrame | None, model_id: str, make_model: ModelFactory,
               k: int, fold_col: str = "fold", key: str = "row_id", label: str = "label", slots: int = SLOTS) -> DataFrame:
    """ev01: for each fold i fit on fold != i, score fold i (out of fold) and
    every test row; ``slots`` fits at a time.  Returns the long score table (materialised)."""
    models = in_parallel(data.sparkSession, _fold_fits(data, make_model, k, fold_col), slots)
    return _fold_scores(models, data, test, model_id, fold_col, key, label)


def oof_family(data: DataFrame, test: DataFrame | None, makers: dict[str, ModelFactory], k: int, fold_col: str = "fold", slots: int = SLOTS) -> DataFrame:
    """ev01 for several models: the fits of all models and folds share the ``slots``."""
    fits = [fit for make in makers.values() for fit in _fold_fits(data, make, k, fold_col)]
    models = in_parallel(data.sparkSession, fits, slots)
    return union_all([_fold_scores(models[n * k:(n + 1) * k], data, test, name, fold_col) for n, name in enumerate(makers)])


def _fold_scores(models: Sequence, data: DataFrame, test: DataFrame | None, model_id: str, fold_col: str = "fold", key: str = "row_id",
                 label: str = "label") -> DataFrame:
    parts = []
    for i, m in enumerate(models):
        parts.append(M.score(m, data.filter(F.col(fold_col) == i), [key, label])
                     .select(key, F.lit("train").alias("split"), F.lit(i).alias("fold"), "proba", label))
        if test is not None:
            parts.append(M.score(m, test, [key, label])
                         .select(key, F.lit("test").alias("split"), F.lit(i).alias("fold"), "proba", label))
    return materialize(union_all(parts).withColumn("model_id", F.lit(model_id)), f"oof-{model_id}")


def fold_f1(oof: DataFrame, label: str = "label", floor: float = 0.0) -> DataFrame:
    """Per (model, fold) F1 of the out-of-fold rows, optionally floored."""
    t = SC.f1_table(oof.filter(F.col("split") == "train"), label, "proba", ["model_id", "fold"])
    return t.select("model_id", "fold", F.greatest(F.col("f1"), F.lit(floor)).alias("f1"))


def test_scores(oof: DataFrame, mode: str = "mean", label: str = "label", floor: float = 1e-6) -> DataFrame:
    """ev02 (mean over fold models) / ev03 (fold-F1-weighted mean)."""
    test = oof.filter(F.col("split") == "test")
    if mode == "mean":
        return SC.mean_score(test, ["row_id", "model_id", label], out="proba")
    w = fold_f1(oof, label, floor).withColumnRenamed("f1", "weight")
    return SC.weighted_mean(test, w, ["row_id", "model_id", label], ["model_id", "fold"], out="proba")


def meta_wide(long: DataFrame, models: Sequence[str], split: str, key: str = "row_id",
              label: str = "label") -> DataFrame:
    """Pivot one split of a long score table to ``{model}__proba_pos`` columns."""
    s = long.filter(F.col("split") == split)
    # OOF rows have one fold; test rows k, whose mean is taken in the same aggregation
    w = s.groupBy(key, label).pivot("model_id", list(models)).agg(F.avg("proba"))
    return w.select(key, label, *[F.col(m).alias(f"{m}__proba_pos") for m in models])


# ---------------------------------------------------------------- ev04 / ev05 / ev06 / ev08 / ev09

def stack_v1(data: DataFrame, feature_cols: Sequence[str], base: dict[str, ModelFactory], k: int = 5,
             meta_name: str = "logistic") -> DataFrame:
    """ev04: original features + OOF columns -> meta model; the meta model is
    fitted on folds 0-2 and validated on folds 3-4."""
    longs = [oof_scores(data, None, mid, f, k) for mid, f in base.items()]
    wide = meta_wide(union_all(longs), list(base), "train").drop("label")
    both = materialize(data.join(wide, "row_id"), "stack-v1")  # read by every pass of the meta fit
    cols = list(feature_cols) + [f"{m}__proba_pos" for m in base]
    meta = M.scaled_pipeline(cols, M.make_estimator(meta_name)).fit(both.filter(F.col("fold") < 3))
    return M.score(meta, both.filter(F.col("fold") >= 3), ["row_id", "label"])


def stack_v2(train: DataFrame, holdout: DataFrame, feature_cols: Sequence[str], base: dict[str, ModelFactory],
             k: int = 5, n_pcs: int = 2, meta_name: str = "logistic") -> DataFrame:
    """ev05: base OOF on the training part, hold-out scored by fold models;
    PCA of the base scores fitted on the training part only (fe12); meta
    model on features + PCs; returns hold-out predictions."""
    long = union_all([oof_scores(train, holdout, mid, f, k) for mid, f in base.items()])
    tr = materialize(train.join(meta_wide(long, list(base), "train").drop("label"), "row_id"), "stack-v2")
    ho = holdout.join(meta_wide(long, list(base), "test").drop("label"), "row_id")
    meta_cols = [f"{m}__proba_pos" for m in base]
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=meta_cols, outputCol="_meta")
    pca = M.pca_pipeline("_meta", n_pcs, "_pcs").fit(va.transform(tr))
    expand = lambda d: pca.transform(va.transform(d)).select(
        "*", *[F.element_at(M.vector_to_array("_pcs"), i + 1).alias(f"MetaFeatsPC_{i + 1}") for i in range(n_pcs)]
    ).drop("_meta", "_pcs", "_centred")
    tr = materialize(expand(tr), "stack-v2-components")  # read by every pass of the meta fit
    ho = expand(ho)
    cols = list(feature_cols) + [f"MetaFeatsPC_{i + 1}" for i in range(n_pcs)]
    meta = M.scaled_pipeline(cols, M.make_estimator(meta_name)).fit(tr)
    return M.score(meta, ho, ["row_id", "label"])


def top_k_feature_member(data: DataFrame, test: DataFrame, feature_cols: Sequence[str], k_feats: int,
                         folds: int = 5, slots: int = SLOTS) -> tuple[DataFrame, dict[int, list[str]]]:
    """ev08: an extra OOF member on the top-k features by tree importance (wn08).

    The importances of fold i come from the rows outside fold i, so held-out
    labels never choose the features; the trees of all folds grow together, the
    members are fitted ``slots`` at a time.  Returns (scores, features by fold)."""
    trees = B.fit_folds(data, feature_cols, folds, {"n_estimators": 10}, slots=slots)

    def one(i: int) -> tuple[list[str], object]:
        fit = data.filter(F.col("fold") != i)
        best = M.importances(trees[i], feature_cols).orderBy(F.desc("importance"), "feature").limit(k_feats)
        names = [r["feature"] for r in best.collect()]   # k column names
        return names, M.scaled_pipeline(names, M.make_estimator("logistic")).fit(fit)

    parts, chosen = [], {}
    for i, (names, m) in enumerate(in_parallel(data.sparkSession, [lambda i=i: one(i) for i in range(folds)], slots)):
        chosen[i] = names
        for split, rows in (("train", data.filter(F.col("fold") == i)), ("test", test)):
            parts.append(M.score(m, rows, ["row_id", "label"]).select("row_id", F.lit(split).alias("split"), F.lit(i).alias("fold"), "proba", "label"))
    return materialize(union_all(parts).withColumn("model_id", F.lit(f"top{k_feats}")), f"oof-top{k_feats}"), chosen


# ---------------------------------------------------------------- ev15-ev18, ev20

def _counts(y, p, threshold):
    hit = p > threshold
    return [F.sum((cond).cast("double")) for cond in ((y == 1) & hit, (y == 0) & hit, (y == 1) & ~hit, (y == 0) & ~hit)]


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _metric(pick):
    return lambda y, p, threshold=0.5: pick(*_counts(y, p, threshold))


#: Metrics as callables (label, proba) -> aggregate expression; "auc" needs ranks and has a pass of its own.
METRICS = {
    "f1": _metric(lambda tp, fp, fn, tn: _ratio(2 * tp, 2 * tp + fp + fn)),
    "precision": _metric(lambda tp, fp, fn, tn: _ratio(tp, tp + fp)),
    "recall": _metric(lambda tp, fp, fn, tn: _ratio(tp, tp + fn)),
    "accuracy": _metric(lambda tp, fp, fn, tn: _ratio(tp + tn, tp + fp + fn + tn)),
    "auc": None,
}


def metric_table(df: DataFrame, metrics: dict, label: str = "label", proba: str = "proba") -> DataFrame:
    """ev20: (metric, value) for named and user metrics: one aggregation for all of them, one more pass for AUC."""
    named = [(n, f) for n, f in metrics.items() if f is not None]
    row = df.agg(*[f(F.col(label), F.col(proba)).alias(f"_{i}") for i, (n, f) in enumerate(named)])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_{i}").alias("value")) for i, (n, _) in enumerate(named)])
    out = row.select(F.explode(pairs).alias("m")).select("m.*")
    if "auc" in metrics:
        out = out.unionByName(SC.auc(df, label, proba).select(F.lit("auc").alias("metric"), F.col("auc").alias("value")))
    return out


def evaluate(df: DataFrame, metric: str | Callable = "f1", label: str = "label", proba: str = "proba") -> float:
    """ev20 as one number: a metric by name, or a callable (label, proba) -> aggregate expression."""
    if not callable(metric) and metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    name = "_user" if callable(metric) else metric
    return float(metric_table(df, {name: metric if callable(metric) else METRICS[metric]}, label, proba).first()["value"])


def before_after(fits: dict[str, DataFrame], test: DataFrame, make_model: ModelFactory) -> DataFrame:
    """pl07: F1, precision, recall and AUC on ``test`` of the model fitted on each training set."""
    parts = []
    for which, train in fits.items():
        model = make_model().fit(M.class_weights(train, "label", "balanced", "weight"))
        scored = M.score(model, test, ["row_id", "label"])
        parts.append(metric_table(scored, METRICS).withColumn("which", F.lit(which)))
    return union_all(parts).groupBy("which").pivot("metric", list(METRICS)).agg(F.first("value"))


def validation_curve(data: DataFrame, model_name: str, param: str, values: Sequence, feature_cols: Sequence[str],
                     k: int = 3, fold_col: str = "fold3", slots: int = SLOTS) -> DataFrame:
    """ev15: train and validation F1 per parameter value over k folds (the
    fold frame is written once), summarised as mean and population std;
    ``slots`` fits at a time."""
    spark = data.sparkSession
    data = materialize(data, "curve")

    def point(v, i: int) -> list[tuple]:
        est = M.scaled_pipeline(feature_cols, M.make_estimator(model_name, {param: v}, weight="weight"))
        m = est.fit(data.filter(F.col(fold_col) != i))
        parts = (("train", F.col(fold_col) != i), ("valid", F.col(fold_col) == i))
        return [(str(v), i, name, evaluate(M.score(m, data.filter(part), ["label"]))) for name, part in parts]

    tasks = [lambda v=v, i=i: point(v, i) for v in values for i in range(k)]
    rows = [r for found in in_parallel(spark, tasks, slots) for r in found]
    res = spark.createDataFrame(rows, "param_value string, fold int, part string, f1 double")
    return res.groupBy("param_value", "part").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))


def draw_settings(spec: dict, n: int, seed: int = 42) -> list[dict]:
    """ev16: seeded draws from ranges: (lo, hi) float uniform, (lo, hi, 'int')
    inclusive ints, (lo, hi, 'log') log-uniform, optional 4th item = decimals."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = {}
        for name, r in spec.items():
            lo, hi = r[0], r[1]
            kind = r[2] if len(r) > 2 else "float"
            if kind == "int":
                s[name] = rng.randint(int(lo), int(hi))
            elif kind == "log":
                s[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                s[name] = rng.uniform(lo, hi)
            if len(r) > 3 and kind != "int":
                s[name] = round(s[name], r[3])
        out.append(s)
    return out


def draw_discrete(choices: dict[str, dict[str, Sequence]], n: int, seed: int = 42) -> list[tuple[str, dict]]:
    """ev17: model families round-robin, each parameter drawn from its list."""
    rng = random.Random(seed)
    fams = list(choices)
    return [(fams[i % len(fams)], {p: rng.choice(list(v)) for p, v in choices[fams[i % len(fams)]].items()})
            for i in range(n)]


def run_experiments(data: DataFrame, feature_cols: Sequence[str], experiments: Sequence[tuple[str, dict]],
                    k: int = 5, metric: str = "f1", slots: int = SLOTS) -> DataFrame:
    """ev16-ev18: cross-validated score per (model, setting); one row each,
    ranked.  Each fit is a set of Spark jobs, ``slots`` fits of any run and fold at a time."""
    spark = data.sparkSession

    def factory(name: str, params: dict) -> ModelFactory:
        return lambda: M.scaled_pipeline(feature_cols, M.make_estimator(name, params, weight="weight", n_features=len(feature_cols)))

    fits = [f for name, params in experiments for f in _fold_fits(data, factory(name, params), k, "fold")]
    models = in_parallel(spark, fits, slots)

    def one(run: int, name: str, params: dict) -> tuple:
        oof = _fold_scores(models[run * k:(run + 1) * k], data, None, f"run{run}")
        score = evaluate(oof.filter(F.col("split") == "train"), metric)
        return f"run{run}", name, {kk: str(v) for kk, v in params.items()}, float(score)

    rows = in_parallel(spark, [lambda r=r, e=e: one(r, *e) for r, e in enumerate(experiments)], slots)
    res = spark.createDataFrame(rows, "run_id string, model string, params map<string,string>, cv_score double")
    from pyspark.sql import Window
    return res.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cv_score"), "run_id")))


# ---------------------------------------------------------------- pl02 / pl05 / pl08

STEP_LOG = ("step int, cv_f1 double, added_pos long, added_neg long, added_cumulative long, threshold_pos_used double, "
            "threshold_neg_used double, stopped boolean")
_ADDED = "row_id long, label double, step int"


def _stored(spark, path: str, schema: str) -> DataFrame | None:
    """The table at ``path`` if a finished write left one."""
    from pyspark.errors import AnalysisException
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def self_training(train: DataFrame, test: DataFrame, members: dict[str, ModelFactory], k: int = 5,
                  max_steps: int = 10, pos_base: float = 0.8, growth: float = 1.1,
                  pos_schedule: Sequence[float] | None = None, neg_threshold: float = 0.1, ratio: float = 4,
                  patience: int = 1, negatives_without_positives: str = "none", seed: int = 42, store: str | None = None,
                  slots: int = SLOTS):
    """pl02 (iterative) and pl05 (pool: ``pos_schedule`` per step, the last
    value repeating).  Each step: soft-voting OOF on train + added rows, F1 on
    the original training rows, test score = mean over folds and members,
    select (pl03), stop test first (pl04), then add.  Returns (added, steps).

    Every step leaves two tables under ``store``: the rows it picked and, last,
    its log row.  A rerun with the same ``store`` takes finished steps from there
    and goes on with the first one that has no log row; its arguments must be
    those of the first run."""
    spark = train.sparkSession
    store = store or scratch_dir(spark, "self-training")
    state, picks, log = StopState(), [], []
    # Only the original rows have folds and are held out; pseudo rows (fold -1) join every fit.
    own = materialize(stratified_kfold(train.drop("fold", "weight"), k, seed, "label").withColumn("origin", F.lit("train")), "own-folds")
    for step in range(max_steps):
        at = f"{store}/step-{step:03d}"
        done = _stored(spark, f"{at}/log", STEP_LOG)
        if done is None:
            added = union_all(picks) if picks else spark.createDataFrame([], _ADDED)
            row = _self_training_step(own, test, added, members, k, step, state, log, at, slots, seed,
                                      pos_schedule[min(step, len(pos_schedule) - 1)] if pos_schedule else pos_base * growth ** step,
                                      neg_threshold, ratio, patience, negatives_without_positives)
            spark.createDataFrame([row], STEP_LOG).coalesce(1).write.mode("overwrite").parquet(f"{at}/log")
        else:
            row = tuple(done.first())
            should_stop(state, row[1], row[2] + row[3], patience)
        log.append(row)
        if row[-1]:
            break
        picks.append(spark.read.schema(_ADDED).parquet(f"{at}/picked"))
    added = union_all(picks) if picks else spark.createDataFrame([], _ADDED)
    return added, spark.createDataFrame(log, STEP_LOG)


def _self_training_step(own: DataFrame, test: DataFrame, added: DataFrame, members: dict[str, ModelFactory], k: int, step: int, state: StopState,
                        log: list[tuple], at: str, slots: int, seed: int, pos_threshold: float, neg_threshold: float, ratio: float, patience: int,
                        without_positives: str) -> tuple:
    """One step: fits, scores, selection; writes the picked rows under ``at`` and returns the log row."""
    spark = own.sparkSession
    more = added.drop("step").join(test.drop("label"), "row_id").withColumn("fold", F.lit(-1)).withColumn("origin", F.lit("pseudo"))
    cur = materialize(M.class_weights(own.unionByName(more.select(*own.columns)), "label", "balanced", "weight"), "step-rows")
    pool = materialize(test.join(added.select("row_id"), "row_id", "left_anti").withColumn("label", F.lit(0.0)), "step-pool")
    longs = in_parallel(spark, [lambda m=m, f=f: oof_scores(cur, pool, m, f, k, slots=1) for m, f in members.items()], slots)
    long = union_all(longs)
    # Pseudo rows are in no fold, so the scored training rows are the original ones.
    f1 = evaluate(SC.mean_score(long.filter(F.col("split") == "train"), ["row_id", "label"], out="proba"))
    test_p = SC.mean_score(long.filter(F.col("split") == "test"), ["row_id"], out="p")
    picked = select_step(test_p, None, pos_threshold, neg_threshold, ratio, negatives_without_positives=without_positives)
    picked = picked.select("row_id", F.col("pseudo_label").cast("double").alias("label"), F.lit(step).alias("step"))
    picked.write.mode("overwrite").parquet(f"{at}/picked")
    n = {r["label"]: r["count"] for r in spark.read.schema(_ADDED).parquet(f"{at}/picked").groupBy("label").count().collect()}
    n_pos, n_neg = n.get(1.0, 0), n.get(0.0, 0)
    stop = should_stop(state, f1, n_pos + n_neg, patience)
    before = log[-1][4] if log else 0
    return step, float(f1), n_pos, n_neg, before + (0 if stop else n_pos + n_neg), float(pos_threshold), float(neg_threshold), stop
