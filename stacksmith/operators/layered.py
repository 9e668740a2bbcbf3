"""Three-layer stack with or without pseudo rows (ev06, ev09, wn08).

Layer 1: base models, one fit per model and fold.  Every fitted row is scored by
the models of its own fold, which did not see it.  Layer 2: principal components
of the base scores, fitted over train and added rows together.  Layer 3: several
meta models on features and components, again one fit per model and fold.  Rows
outside the fit get, per model, the mean over its fold models weighted by their
F1 on held-out training rows; the metas are blended by weights from their mean F1.

Folds are dealt within each origin (train, pseudo), so fold i of one pairs with
fold i of the other, and every fit sees k - 1 folds of both.  F1 that weighs a
model counts training rows only: pseudo labels are no truth.

Scores of a layer are columns added by one narrow pass per fold, so no score
table is pivoted or joined back.  Fits run a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacksmith.operators import boosted as B
from stacksmith.operators import models as M
from stacksmith.operators import scores as SC
from stacksmith.operators.parallel import SLOTS, in_parallel
from stacksmith.operators.rank import cut
from stacksmith.operators.sampling import stratified_kfold

#: A factory of unfitted models on the given feature columns, reading ``label`` and ``weight``.
ModelOn = Callable[[Sequence[str]], Estimator]
_MODEL_COLUMNS = ("_raw", "features", "rawPrediction", "probability", "prediction")


def model_on(name: str, params: dict | None = None) -> ModelOn:
    """A registered estimator by name, scaled on the rows it is fitted on."""
    return lambda cols: M.scaled_pipeline(cols, M.make_estimator(name, params, weight="weight", n_features=len(cols)))


class FoldedTrees:
    """Boosted trees whose folds a layer fits together (``boosted``); called, the registered estimator as of ``model_on``."""

    def __init__(self, params: dict | None = None) -> None:
        self.params = params

    def __call__(self, cols: Sequence[str]) -> Estimator:
        return model_on("gbt", self.params)(cols)

    def fit_folds(self, rows: DataFrame, cols: Sequence[str], k: int, slots: int) -> list:
        return B.fit_folds(rows, cols, k, self.params, "weight", slots=slots)


def _score_columns(df: DataFrame, fitted: dict[str, object]) -> DataFrame:
    """``df`` with the positive probability of every fitted model in the column it is named by."""
    for column, model in fitted.items():
        df = model.transform(df).withColumn(column, M.proba_pos()).drop(*_MODEL_COLUMNS)
    return df


class FoldedLayer:
    """One layer: a model per (name, fold), the F1 of each on its held-out training rows, and its importances."""

    def __init__(self, name: str, cols: Sequence[str], factories: dict[str, ModelOn], k: int, floor: float, slots: int) -> None:
        self.name, self.cols, self.factories = name, list(cols), factories
        self.k, self.floor, self.slots = k, floor, slots
        self.models: dict[tuple[str, int], object] = {}
        self.f1: dict[tuple[str, int], float] = {}

    def column(self, model_id: str) -> str:
        return f"{model_id}__{self.name}"

    def fit(self, rows: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Fit on ``rows`` (label, weight, fold, origin, features); returns them with the out-of-fold score columns, written.

        ``keep``: the columns of ``rows`` to return; label, fold and origin must be among them.
        """
        alone = [m for m, make in self.factories.items() if not isinstance(make, FoldedTrees)]
        keys = [(m, i) for m in alone for i in range(self.k)]
        fits = [lambda m=m, i=i: self.factories[m](self.cols).fit(rows.filter(F.col("fold") != i)) for m, i in keys]
        found = dict(zip(keys, in_parallel(rows.sparkSession, fits, self.slots)))
        for m in self.factories:
            if m not in alone:
                found |= {(m, i): model for i, model in enumerate(self.factories[m].fit_folds(rows, self.cols, self.k, self.slots))}
        self.models = {(m, i): found[m, i] for m in self.factories for i in range(self.k)}
        together = [m for m in self.factories if isinstance(self.models[m, 0], B.FoldTrees)]
        apart = [m for m in self.factories if m not in together]
        # One pass where no model needs the folds apart.
        parts = [_score_columns(rows.filter(F.col("fold") == i), {self.column(m): self.models[m, i] for m in apart}) for i in range(self.k)] if apart else [rows]
        scored = reduce(DataFrame.unionByName, parts)
        for m in together:
            scored = scored.withColumn(self.column(m), B.out_of_fold([self.models[m, i] for i in range(self.k)], F.col("fold"), self.cols))
        if keep is not None:
            scored = scored.select(*keep, *[self.column(m) for m in self.factories])
        scored = cut(scored, f"oof-{self.name}")
        own = scored.filter(F.col("origin") == "train")
        for m in self.factories:
            table = SC.f1_table(own, "label", self.column(m), ["fold"]).select("fold", "f1").collect()  # a row a fold
            self.f1 |= {(m, r["fold"]): float(r["f1"] or 0.0) for r in table}
        return scored

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with one column per model: mean over its fold models, weighted by their floored F1."""
        names = {(m, i): f"_{self.name}_{n}_{i}" for n, m in enumerate(self.factories) for i in range(self.k)}
        df = _score_columns(df, {names[key]: self.models[key] for key in names})
        for m in self.factories:
            w = [max(self.f1.get((m, i), 0.0), self.floor) for i in range(self.k)]
            terms = [F.col(names[m, i]) * F.lit(w[i] / sum(w)) for i in range(self.k)]
            df = df.withColumn(self.column(m), reduce(lambda a, b: a + b, terms))
        return df.drop(*names.values())

    def mean_f1(self) -> dict[str, float]:
        return {m: sum(self.f1.get((m, i), 0.0) for i in range(self.k)) / self.k for m in self.factories}

    def importances(self) -> list[tuple[str, str, int, float, str, float]]:
        """(layer, model, fold, F1, feature, importance); models without importances give none."""
        out = []
        for (m, i), model in self.models.items():
            last = model.stages[-1]
            values = getattr(last, "featureImportances", None)
            if values is None and hasattr(last, "coefficients"):
                values = last.coefficients
            if values is not None:
                out += [(self.name, m, i, self.f1.get((m, i), 0.0), f, abs(float(v))) for f, v in zip(self.cols, values.toArray())]
        return out


class LayeredStackModel:
    """Fitted layers; scores any frame that has the feature columns."""

    def __init__(self, base: FoldedLayer, components, n_pcs: int, meta: FoldedLayer, weights: dict[str, float], oof: DataFrame) -> None:
        self.base, self.components, self.n_pcs, self.meta = base, components, n_pcs, meta
        self.weights, self.oof = weights, oof

    def _blend(self, df: DataFrame, threshold: float) -> DataFrame:
        terms = [F.col(self.meta.column(m)) * F.lit(w) for m, w in self.weights.items()]
        return df.withColumn("proba", reduce(lambda a, b: a + b, terms)).withColumn("pred", (F.col("proba") > threshold).cast("int"))

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` with base scores, components, meta scores, the blended ``proba`` and ``pred``."""
        return self._blend(self.meta.score(_with_components(self.base.score(df), self.components, self.n_pcs)), threshold)

    def out_of_fold(self, threshold: float = 0.5) -> DataFrame:
        """The fitted rows, each blended from models that did not see it."""
        return self._blend(self.oof, threshold)

    def f1_by_origin(self, threshold: float = 0.5) -> DataFrame:
        """origin, fold, n, f1 of the blended out-of-fold labels; fold null: the whole origin."""
        rows = self.out_of_fold(threshold)
        parts = [SC.f1_table(rows.withColumn("fold", fold), "label", "proba", ["origin", "fold"], threshold)
                 for fold in (F.col("fold"), F.lit(None).cast("int"))]
        sizes = rows.rollup("origin", "fold").agg(F.count("*").alias("n")).filter("origin is not null")
        both = parts[0].unionByName(parts[1]).select("origin", "fold", "f1").alias("a")
        return both.join(sizes.alias("b"), F.expr("a.origin = b.origin and a.fold <=> b.fold")).select("a.origin", "a.fold", "n", "f1")

    def importances(self) -> DataFrame:
        return importance_table(self.oof.sparkSession, [self.base, self.meta])


def importance_table(spark: SparkSession, layers: Sequence[FoldedLayer]) -> DataFrame:
    """layer, model_id, fold, f1, feature, importance, best_fold (the fold of the model's highest F1, first of equals): a row per model, fold and feature."""
    rows = [r for layer in layers for r in layer.importances()]
    best: dict[tuple[str, str], tuple[float, int]] = {}
    for layer, m, i, f1, *_ in rows:
        best[layer, m] = max(best.get((layer, m), (-1.0, 0)), (f1, -i))
    return spark.createDataFrame([(*r, best[r[0], r[1]][1] == -r[2]) for r in rows],
                                 "layer string, model_id string, fold int, f1 double, feature string, importance double, best_fold boolean")


def top_features(importances: DataFrame, layer: str, model_id: str, k: int = 100) -> DataFrame:
    """wn08: the ``k`` most important features of the model's best fold."""
    mine = importances.filter((F.col("layer") == layer) & (F.col("model_id") == model_id) & F.col("best_fold"))
    ranked = mine.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row a feature
    return ranked.filter(F.col("rank") <= k).select("rank", "fold", "f1", "feature", "importance")


def _with_components(df: DataFrame, components, n_pcs: int) -> DataFrame:
    out = components.transform(df)
    pcs = [F.element_at(M.vector_to_array("_pcs"), i + 1).alias(f"MetaFeatsPC_{i + 1}") for i in range(n_pcs)]
    return out.select("*", *pcs).drop("_meta", "_centred", "_pcs")


def fit_layered_stack(train: DataFrame, base: dict[str, ModelOn], metas: dict[str, ModelOn], cols: Sequence[str], added: DataFrame | None = None,
                      k: int = 5, n_pcs: int | None = None, weight_method: str = "naive", class_weight: str = "balanced", floor: float = 1e-6,
                      seed: int = 42, slots: int = SLOTS) -> LayeredStackModel:
    """Fit on ``train`` and, if given, pseudo rows ``added`` (both: row_id, label, ``cols``).

    Other columns are left out.  A class that has fewer rows than folds is missing from some held-out parts, whose F1 is then 0.
    """
    from pyspark.ml import Pipeline
    own = ["row_id", "label", *cols]
    rows = stratified_kfold(train.select(own).withColumn("origin", F.lit("train")), k, seed, "label")
    if added is not None:
        rows = rows.unionByName(stratified_kfold(added.select(own).withColumn("origin", F.lit("pseudo")), k, seed, "label"))
    rows = cut(M.class_weights(rows, "label", class_weight, "weight"), "stack-rows")
    first = FoldedLayer("proba_pos", cols, base, k, floor, slots)
    scored = first.fit(rows)
    n_pcs = min(n_pcs or len(base), len(base))
    components = Pipeline(stages=[VectorAssembler(inputCols=[first.column(m) for m in base], outputCol="_meta"), M.pca_pipeline("_meta", n_pcs, "_pcs")]).fit(scored)
    scored = cut(_with_components(scored, components, n_pcs), "stack-components")
    last = FoldedLayer("meta", [*cols, *[f"MetaFeatsPC_{i + 1}" for i in range(n_pcs)]], metas, k, floor, slots)
    oof = last.fit(scored)
    f1 = train.sparkSession.createDataFrame(list(last.mean_f1().items()), "model_id string, f1 double")
    weights = {r["model_id"]: float(r["weight"]) for r in SC.model_weights(f1, weight_method).collect()}  # a row a model
    return LayeredStackModel(first, components, n_pcs, last, {m: weights[m] for m in metas}, oof)
