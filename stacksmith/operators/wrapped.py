"""Model families made of several models, as Spark ML estimators (ml09, ml10, ml11, ev17).

They fit, copy, save and load as other estimators do, so they run inside
pipelines, out-of-fold scoring and searches.  A fitted model scores all its
members in one pass over the rows and keeps every row and column; rows are
neither filtered apart nor joined back.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.functions.metrics import binary_report
from stacksmith.operators.models import WEIGHTED, make_estimator, proba_pos, register_estimator


class _Common(HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasWeightCol, HasSeed):
    def _weight(self) -> str | None:
        return self.getWeightCol() if self.isDefined(self.weightCol) and self.getWeightCol() else None

    def _member(self, name: str, params: dict, features: str) -> Estimator:
        return make_estimator(name, params, features=features, label=self.getLabelCol(), weight=self._weight())

    @contextmanager
    def _kept(self, df: DataFrame, *more: str) -> Iterator[DataFrame]:
        """What members read of ``df``, kept on the executors while they are fitted: each fit makes several passes."""
        names = dict.fromkeys([self.getFeaturesCol(), self.getLabelCol(), *filter(None, [self._weight()]), *more])
        rows = df.select(*[F.col(f"`{c}`") for c in names]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield rows
        finally:
            rows.unpersist()


class _Writer(MLWriter):
    def __init__(self, model: "_Members") -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"state": json.dumps(m.state), "members": len(m.members)})
        for i, part in enumerate(m.members):
            part.write().save(f"{path}/members/{i}")


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "_Members":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        members = [DefaultParamsReader.loadParamsInstance(f"{path}/members/{i}", self.sparkSession) for i in range(metadata["members"])]
        model = self.cls(members, json.loads(metadata["state"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Members(Model, _Common, MLWritable, MLReadable):
    """A fitted model of member models and a small state of plain values."""

    def __init__(self, members: list | None = None, state: dict | None = None) -> None:
        super().__init__()
        self.members, self.state = members or [], state or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _of(self, estimator: Estimator) -> "_Members":
        for p in (self.featuresCol, self.labelCol, self.probabilityCol, self.weightCol, self.seed):
            if estimator.isDefined(estimator.getParam(p.name)):
                self._set(**{p.name: estimator.getOrDefault(p.name)})
        return self

    def _each(self, df: DataFrame, models: list, features: list[str], tag: str) -> DataFrame:
        """``df`` with P(class 1) of model i as ``{tag}p{i}``."""
        for i, (m, f) in enumerate(zip(models, features)):
            m = m.copy({m.featuresCol: f, m.probabilityCol: f"{tag}v", m.rawPredictionCol: f"{tag}r", m.predictionCol: f"{tag}y"})
            df = m.transform(df).withColumn(f"{tag}p{i}", proba_pos(f"{tag}v")).drop(f"{tag}v", f"{tag}r", f"{tag}y")
        return df

    def _with(self, df: DataFrame, names: list[str], p: Column, also: list[Column] = ()) -> DataFrame:
        out = self.getProbabilityCol()
        return df.select(*[F.col(f"`{c}`") for c in names if c != out], *also, array_to_vector(F.array(1 - p, p)).alias(out))


def _tag() -> str:
    return f"_{uuid4().hex[:8]}_"


class _Json(Params):
    model = Param(Params._dummy(), "model", "registered name of the member model", TypeConverters.toString)
    modelParams = Param(Params._dummy(), "modelParams", "its parameters as JSON", TypeConverters.toString)


class ClusterClassifier(Estimator, _Common, _Json, DefaultParamsReadable, DefaultParamsWritable):
    """ml09: KMeans on the features, one classifier a cluster.

    A cluster without both classes scores its rows with the prior of all
    training rows; a cluster without training rows as well.
    """

    k = Param(Params._dummy(), "k", "clusters", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", probabilityCol="probability", weightCol="", seed=42, k=6,
                 model="logistic", modelParams="{}") -> None:
        super().__init__()
        self._setDefault(probabilityCol="probability", weightCol="", seed=42, k=6, model="logistic", modelParams="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ClusterClassifierModel":
        tag, label = _tag(), self.getLabelCol()
        km = KMeans(k=self.getOrDefault("k"), seed=self.getSeed(), featuresCol=self.getFeaturesCol(), predictionCol=f"{tag}c").fit(df)
        with self._kept(km.transform(df), f"{tag}c") as rows:
            sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy(f"{tag}c").agg(F.count(F.lit(1)), F.sum(label)).collect()}
            n, n1 = (sum(v[i] for v in sizes.values()) for i in (0, 1))
            params, name = json.loads(self.getOrDefault("modelParams")), self.getOrDefault("model")
            fitted = sorted(c for c, (m, m1) in sizes.items() if 0 < m1 < m)
            models = [self._member(name, params, self.getFeaturesCol()).fit(rows.filter(F.col(f"{tag}c") == c).drop(f"{tag}c")) for c in fitted]
        return ClusterClassifierModel([km, *models], {"fitted": fitted, "prior": n1 / n if n else 0.0})._of(self)


class ClusterClassifierModel(_Members):
    """Adds the column ``cluster`` beside the probability."""

    def _transform(self, df: DataFrame) -> DataFrame:
        tag = _tag()
        km = self.members[0]
        names = [c for c in df.columns if c != "cluster"]
        rows = km.copy({km.featuresCol: self.getFeaturesCol(), km.predictionCol: f"{tag}c"}).transform(df)
        fitted = self.state["fitted"]
        rows = self._each(rows, self.members[1:], [self.getFeaturesCol()] * len(fitted), tag)
        p = F.lit(float(self.state["prior"]))
        for i, c in enumerate(fitted):
            p = F.when(F.col(f"{tag}c") == c, F.col(f"{tag}p{i}")).otherwise(p)
        return self._with(rows, names, p, [F.col(f"{tag}c").alias("cluster")])


class SubspaceClassifier(Estimator, _Common, _Json, DefaultParamsReadable, DefaultParamsWritable):
    """ml10: members on random subsets of the features, weighted by their F1 to a power on a part of the training rows.

    That part is every fifth row by a hash of its features: the rows that a
    caller holds out are never among them.  Equal weights when no member scores.
    """

    members = Param(Params._dummy(), "members", "number of members", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "smallest subset", TypeConverters.toInt)
    most = Param(Params._dummy(), "most", "largest subset", TypeConverters.toInt)
    power = Param(Params._dummy(), "power", "power of the F1 in a weight", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", probabilityCol="probability", weightCol="", seed=42, members=6,
                 least=2, most=5, power=1.0, model="logistic", modelParams="{}") -> None:
        super().__init__()
        self._setDefault(probabilityCol="probability", weightCol="", seed=42, members=6, least=2, most=5, power=1.0, model="logistic", modelParams="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SubspaceClassifierModel":
        features, label, tag = self.getFeaturesCol(), self.getLabelCol(), _tag()
        first = df.select(features).first()
        size = len(first[0]) if first else 0
        rng = random.Random(self.getSeed())
        most = min(self.getOrDefault("most"), size)
        picks = [sorted(rng.sample(range(size), rng.randint(min(self.getOrDefault("least"), most), most))) for _ in range(self.getOrDefault("members"))]
        held = F.pmod(F.xxhash64(F.lit(self.getSeed()), F.to_json(F.struct(F.col(features)))), F.lit(5)) == 0
        with self._kept(df.withColumn(f"{tag}h", held), f"{tag}h") as rows:
            own, valid = (rows.filter(c).drop(f"{tag}h") for c in (~F.col(f"{tag}h"), F.col(f"{tag}h")))
            params, name = json.loads(self.getOrDefault("modelParams")), self.getOrDefault("model")
            models = [self._member(name, params, f"{tag}x").fit(VectorSlicer(inputCol=features, outputCol=f"{tag}x", indices=p).transform(own)) for p in picks]
            fitted = SubspaceClassifierModel(models, {"picks": picks, "weights": [1.0] * len(picks)})._of(self)
            scored = fitted.scored(valid, tag)
            names = [f"{tag}p{i}" for i in range(len(picks))]
            long = scored.select(F.col(label).alias("y"), F.posexplode(F.array(*names)).alias("i", "p"))
            f1 = {r["i"]: r["f1"] for r in binary_report(long, "y", "p", ["i"]).collect()}
        weights = [max(0.0, f1.get(i, 0.0)) ** self.getOrDefault("power") for i in range(len(picks))]
        if sum(weights) > 0:
            fitted.state["weights"] = [w / sum(weights) for w in weights]
        return fitted


class SubspaceClassifierModel(_Members):
    def scored(self, df: DataFrame, tag: str) -> DataFrame:
        for i, p in enumerate(self.state["picks"]):
            df = VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=f"{tag}x{i}", indices=p).transform(df)
        return self._each(df, self.members, [f"{tag}x{i}" for i in range(len(self.members))], tag)

    def _transform(self, df: DataFrame) -> DataFrame:
        tag, weights = _tag(), self.state["weights"]
        p = sum((F.lit(w) * F.col(f"{tag}p{i}") for i, w in enumerate(weights)), F.lit(0.0)) / F.lit(sum(weights) or 1.0)
        return self._with(self.scored(df, tag), df.columns, p)


class SoftVoteClassifier(Estimator, _Common, DefaultParamsReadable, DefaultParamsWritable):
    """ml11: the mean probability of several models."""

    models = Param(Params._dummy(), "models", "registered names of the members", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", probabilityCol="probability", weightCol="", seed=42,
                 models=("logistic", "naive_bayes", "random_forest")) -> None:
        super().__init__()
        self._setDefault(probabilityCol="probability", weightCol="", seed=42, models=list(models))
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SoftVoteClassifierModel":
        return SoftVoteClassifierModel([self._member(n, {}, self.getFeaturesCol()).fit(df) for n in self.getOrDefault("models")])._of(self)


class SoftVoteClassifierModel(_Members):
    def _transform(self, df: DataFrame) -> DataFrame:
        tag, n = _tag(), len(self.members)
        p = sum((F.col(f"{tag}p{i}") for i in range(n)), F.lit(0.0)) / F.lit(float(n))
        return self._with(self._each(df, self.members, [self.getFeaturesCol()] * n, tag), df.columns, p)


# The families by name, for searches and out-of-fold scoring.
WEIGHTED.update({"cluster_then_classify", "random_subspace", "soft_voting"})


@register_estimator("cluster_then_classify")
def _cluster(features="features", label="label", weight=None, **p):
    return ClusterClassifier(featuresCol=features, labelCol=label, weightCol=weight or "", seed=p.get("seed", 42), k=p.get("k", 6),
                             model=p.get("model", "logistic"), modelParams=json.dumps(p.get("model_params", {})))


@register_estimator("random_subspace")
def _subspace(features="features", label="label", weight=None, **p):
    return SubspaceClassifier(featuresCol=features, labelCol=label, weightCol=weight or "", seed=p.get("seed", 42), members=p.get("members", 6),
                              least=p.get("least", 2), most=p.get("most", 5), power=p.get("power", 1.0),
                              model=p.get("model", "logistic"), modelParams=json.dumps(p.get("model_params", {})))


@register_estimator("soft_voting")
def _vote(features="features", label="label", weight=None, **p):
    return SoftVoteClassifier(featuresCol=features, labelCol=label, weightCol=weight or "", seed=p.get("seed", 42),
                              models=list(p.get("models", ("logistic", "naive_bayes", "random_forest"))))
