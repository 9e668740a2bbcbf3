"""Gradient boosted trees of all folds in the same passes over the rows (ev08, wn08).

The method is MLlib's GBTClassifier behind a StandardScaler, fitted once per
fold on the rows outside it: bins at weighted quantiles of the standardised
values (of about 10 000 rows, as in MLlib), least-squares trees on the gradient
of the logistic loss, a first tree of weight 1 and the others of the step size,
importances as weighted gains.  MLlib keeps binned rows as arrays of integers
once a fold and reads the input four times more a fold; here the bins of
all folds are written once, a byte each in small blocks of rows, and a level of
the trees of all folds is one pass over them.

Folds of up to SMALL rows are fitted by MLlib itself: there different splits of
a few rows often gain the same, and rounding decides which one it takes.

Gains need no sum of squares, and a feature with one threshold only the sums of
its upper bin.  Splits that divide the rows alike go to the first feature.
Null and NaN values leave their feature without thresholds in the folds that
are fitted on them, as their mean is NaN.  Sums of a level (a fixed size a
fold) reach the driver; trees travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.operators import models as M
from stacksmith.operators.parallel import SLOTS, in_parallel
from stacksmith.operators.rank import cut

#: Rows that thresholds are taken from (MLlib's figure).
SAMPLE = 10_000
#: Largest fit that is left to MLlib.
SMALL = 10_000
#: Rows of a block of the written bins (10 000 blocks, an Arrow batch, stay under 200 MB), blocks summed at a time, and the fold of rows that fill a block up.
BLOCK, CHUNK, NONE = 64, 156, 255


class FoldTrees:
    """The fitted model of one fold; ``featureImportances`` and ``transform`` are those of an MLlib model."""

    def __init__(self, cols: Sequence[str], mean: np.ndarray, scale: np.ndarray, thresholds: list[np.ndarray], depth: int) -> None:
        self.cols, self.mean, self.scale, self.thresholds, self.depth = list(cols), mean, scale, thresholds, depth
        self.trees: list[tuple[float, dict[int, tuple[int, int]], np.ndarray]] = []  # weight, {node: (feature, bin)}, values
        self.gains = np.zeros(len(cols))

    @property
    def stages(self) -> list["FoldTrees"]:
        return [self]

    @property
    def featureImportances(self) -> DenseVector:
        total = self.gains.sum()
        return Vectors.dense(self.gains / total if total > 0 else self.gains)

    @property
    def wide(self) -> list[int]:
        """Features with several thresholds."""
        return [f for f, e in enumerate(self.thresholds) if len(e) > 1]

    @property
    def thin(self) -> list[int]:
        """Features with one threshold."""
        return [f for f, e in enumerate(self.thresholds) if len(e) == 1]

    def bins(self, x: Sequence[np.ndarray], orders: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """Bins by feature, from one array of values a feature; ``orders`` keeps the values' orders for other models."""
        out, orders = {}, {} if orders is None else orders
        with np.errstate(all="ignore"):
            for f in [*self.wide, *self.thin]:
                edges, v = self.thresholds[f], (x[f] - self.mean[f]) * self.scale[f]
                if len(edges) == 1:
                    out[f] = (v > edges[0]).view(np.uint8)
                    continue
                if f not in orders:
                    orders[f] = np.argsort(x[f])
                # Where the values pass each threshold: standardising keeps their order.
                ends = np.searchsorted(v[orders[f]], edges, "right")
                out[f] = np.empty(len(v), np.uint8)
                out[f][orders[f]] = np.repeat(np.arange(len(edges) + 1, dtype=np.uint8), np.diff(ends, prepend=0, append=len(v)))
        return out

    def margin(self, bins: dict[int, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros(n)
        for weight, splits, values in self.trees:
            out += weight * values[_node_of(bins, splits, n)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        p = out_of_fold([self], F.lit(0), self.cols)
        return df.withColumn("probability", p).withColumn("probability", array_to_vector(F.array(1 - F.col("probability"), F.col("probability"))))


def out_of_fold(models: Sequence[FoldTrees], fold: Column, cols: Sequence[str]) -> Column:
    """P(class 1) of each row by the model of its ``fold``."""
    def run(of: pa.Array, *values: pa.Array) -> pa.Array:
        of, x = of.to_numpy(zero_copy_only=False), [v.to_numpy(zero_copy_only=False) for v in values]
        p = np.zeros(len(of))
        for i, m in enumerate(models):
            mine = np.flatnonzero(of == i)
            p[mine] = 1 / (1 + np.exp(-2 * m.margin(m.bins([v[mine] for v in x]), len(mine))))
        return pa.array(p)

    return F.arrow_udf(run, "double")(fold.cast("int"), *[F.col(f"`{c}`").cast("double") for c in cols])


def _node_of(bins: dict[int, np.ndarray], splits: dict[int, tuple[int, int]], n: int) -> np.ndarray:
    """Heap number (root 1) of the node in which each of ``n`` rows ends."""
    at = np.ones(n, np.uint8)
    for node in sorted(splits):
        f, b = splits[node]
        at += (at == node).view(np.uint8) * (np.uint8(node) + (bins[f] > b).view(np.uint8))
    return at


def edges_of(v: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between values: between all neighbours, or nearest to equal weights."""
    if not len(v) or np.isnan(v).any():
        return np.empty(0)
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    values, weights = v[first], np.add.reduceat(w, first)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    stride, sums, out = weights.sum() / (most + 1), np.cumsum(weights).tolist(), []
    target = stride
    for i in range(1, len(sums)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            out.append(i - 1)
            target += stride
    return middle[out]


def _given(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], names=["fold", "sums"])


def _vector_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(data.as_buffer(), "<f8")
            total[i] = total[i] + part if i in total else part
    yield from _given(total)


def _summed(df: DataFrame, step, k: int) -> dict[int, np.ndarray]:
    """Sums by fold of what ``step`` gives for each task's rows."""
    schema = "fold int, sums binary"
    rows = df.mapInArrow(step, schema).repartition(k, "fold").mapInArrow(_vector_sums, schema).collect()  # a row a fold
    return {r[0]: np.frombuffer(r[1], "<f8") for r in rows}


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _moments(pivot: np.ndarray):
    """Sums of the values and of their squares, both from ``pivot``, by fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                fold, _, _, *x = _numbers(batch)
                for i in np.unique(fold).tolist():
                    mine = fold == i
                    d = [v[mine] - c for v, c in zip(x, pivot)]
                    part = np.array([a.sum() for a in d] + [a @ a for a in d])
                    sums[i] = sums[i] + part if i in sums else part
        yield from _given(sums)
    return run


def _alike(models: list[FoldTrees]) -> bool:
    return all(m.thin == models[0].thin for m in models)


def _binned(models: list[FoldTrees]):
    """One record a block of BLOCK rows: by row the fold (NONE where a block is filled up), label and weight, then the bins by feature;
    of features with one threshold once, where all folds have the same bins, and else by fold."""
    alike = _alike(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, label, weight, *x = _numbers(batch)
            orders: dict[int, np.ndarray] = {}
            bins, n = [m.bins(x, orders) for m in models], len(fold)
            wide = np.zeros((sum(len(m.wide) for m in models), -(-n // BLOCK) * BLOCK), np.uint8)
            thin = np.zeros((sum(len(m.thin) for m in models), wide.shape[1]), np.uint8)
            for to, rows in ((wide, [b[f] for m, b in zip(models, bins) for f in m.wide]), (thin, [b[f] for m, b in zip(models, bins) for f in m.thin])):
                for r, v in enumerate(rows):
                    to[r, :n] = v
            once = len(models[0].thin)
            if alike and all((thin[:once] == thin[i * once:(i + 1) * once]).all() for i in range(1, len(models))):
                thin = thin[:once]
            own = np.full(wide.shape[1], NONE, np.uint8), *np.zeros((2, wide.shape[1]))
            for to, v in zip(own, (fold, label, weight)):
                to[:n] = v
            records = []
            for lo in range(0, n, BLOCK):
                part = slice(lo, lo + BLOCK)
                records.append(b"".join([*(v[part].tobytes() for v in own), wide[:, part].tobytes(), thin[:, part].tobytes()]))
            yield pa.record_batch([pa.array(records, pa.binary())], names=["block"])
    return run


def _chunks(column: pa.Array) -> Iterator[np.ndarray]:
    """Up to CHUNK blocks of one length at a time: (blocks, bytes)."""
    data, ends = np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    sizes, lo = np.diff(ends), 0
    while lo < len(sizes):
        hi = lo + 1
        while hi < min(len(sizes), lo + CHUNK) and sizes[hi] == sizes[lo]:
            hi += 1
        yield data[ends[lo]:ends[hi]].reshape(hi - lo, -1)
        lo = hi


def _read(blocks: np.ndarray, wides: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fold, label, weight, and bins (features, rows) of features with several thresholds and of those with one."""
    fold, label, weight, rest = np.split(blocks, [BLOCK, 9 * BLOCK, 17 * BLOCK], axis=1)
    bins = np.ascontiguousarray(rest.reshape(len(blocks), -1, BLOCK).transpose(1, 0, 2)).reshape(rest.shape[1] // BLOCK, -1)
    return fold.ravel(), np.ascontiguousarray(label).view(np.float64).ravel(), np.ascontiguousarray(weight).view(np.float64).ravel(), bins[:wides], bins[wides:]


def _level(shared, level: int, bins: int):
    """Sums of weight and weighted target by node of the level, feature and bin, of each fold's fit; of the nodes to be counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, growing = shared.value
        size, count, sums = 1 << level, len(models[0].cols), {}
        wide, thin = [m.wide for m in models], [m.thin for m in models]
        first_wide, first_thin = (np.cumsum([0, *map(len, x)]) for x in (wide, thin))
        for fold, label, weight, many, few in (_read(c, first_wide[-1]) for batch in batches for c in _chunks(batch.column(0))):
            n, y = len(fold), 2 * label - 1
            # Bins that all folds share are looked through once.
            shared_thin = len(few) != first_thin[-1] or len(models) == 1
            upper_rows = np.divmod(np.flatnonzero(few), n) if shared_thin else None
            for i, (m, (splits, _, counted)) in enumerate(zip(models, growing)):
                if not counted:
                    continue
                lows = few if shared_thin else few[first_thin[i]:first_thin[i + 1]]
                b = dict(zip(wide[i], many[first_wide[i]:first_wide[i + 1]])) | dict(zip(thin[i], lows))
                node = _node_of(b, splits, n)
                # Rows of the held-out fold and of other nodes weigh nothing.
                mine = (fold != i) & np.isin(node, counted)
                w, own = np.where(mine, weight, 0.0), np.flatnonzero(mine)
                slot = np.where(node >= size, node - size, 0).astype(np.intp)
                target = y
                if m.trees:
                    with np.errstate(over="ignore"):
                        target = 4 * y / (1 + np.exp(2 * y * m.margin(b, n)))
                wt = w * target
                if i not in sums:
                    sums[i] = np.zeros((2, size, count, bins))
                h, base, pair = sums[i], slot[own] * bins, (w[own], wt[own])
                for f in wide[i]:
                    key = base + b[f][own]
                    for j, v in enumerate(pair):
                        h[j, :, f] += np.bincount(key, v, size * bins).reshape(size, bins)
                if thin[i]:
                    f, r = upper_rows or np.divmod(np.flatnonzero(lows), n)
                    key = f * size + slot[r]
                    for j, v in enumerate((w, wt)):
                        upper = np.bincount(key, v[r], len(thin[i]) * size).reshape(-1, size)
                        h[j][:, thin[i], 1] += upper.T
                        h[j][:, thin[i], 0] += (np.bincount(slot, v, size) - upper).T
        yield from _given({i: h.ravel() for i, h in sums.items()})
    return run


def _best(w: np.ndarray, s: np.ndarray, edges: Sequence[int], first: bool = False) -> tuple[float, int, int, tuple[float, float], tuple[float, float]] | None:
    """(gain, feature, bin, lower weight and sum, upper ones) of the best split of a node; w, s: (features, bins).

    ``first``: the targets are 1 and -1.  Different splits may then gain the same, and MLlib's formula tells which it takes.
    """
    some = np.flatnonzero(edges)
    if not len(some):
        return None
    w, s = w[some], s[some]
    total_w, total_s = w.sum(axis=1, keepdims=True), s.sum(axis=1, keepdims=True)
    least = 1e-10 * total_w
    low_w, low_s = np.cumsum(w, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
    up_w, up_s = np.cumsum(w[:, ::-1], axis=1)[:, ::-1][:, 1:], np.cumsum(s[:, ::-1], axis=1)[:, ::-1][:, 1:]
    valid = (low_w > least) & (up_w > least) & (np.arange(low_w.shape[1]) < np.asarray(edges)[some][:, None])
    with np.errstate(all="ignore"):
        gain = np.where(valid, low_s ** 2 / low_w + up_s ** 2 / up_w - total_s ** 2 / total_w, -np.inf)
        whole = float(np.max(total_s ** 2 / total_w)) if (total_w > 0).all() else 0.0
    top = gain.max()
    if not top > 1e-12 * whole or not top > 0:
        return None
    chosen = gain >= top - 1e-12 * (top + whole)
    if first:
        spread = lambda n, t: (n - t * t / n) / n
        with np.errstate(all="ignore"):
            exact = spread(total_w, total_s) - low_w / total_w * spread(low_w, low_s) - up_w / total_w * spread(up_w, up_s)
        chosen &= exact == exact[chosen].max()
    f, b = np.unravel_index(int(np.argmax(chosen)), gain.shape)
    return float(gain[f, b]), int(some[f]), int(b), (float(low_w[f, b]), float(low_s[f, b])), (float(up_w[f, b]), float(up_s[f, b]))


def fit_folds(rows: DataFrame, cols: Sequence[str], k: int, params: dict | None = None, weight: str | None = None, fold: str = "fold",
              label: str = "label", slots: int = SLOTS) -> list[FoldTrees] | list[PipelineModel]:
    """One model a fold, on the rows (0/1 ``label``) of the other folds; ``params`` as of the registered estimator "gbt"."""
    p = params or {}
    trees, depth, bins, step, seed = p.get("n_estimators", 20), p.get("max_depth", 4), p.get("max_bins", 32), p.get("learning_rate", 0.1), p.get("seed", 42)
    if bins > 256 or depth > 6 or k >= NONE or p.get("subsample", 1.0) != 1.0:
        raise ValueError("at most 256 bins, six levels, 254 folds and no subsampling")
    spark = rows.sparkSession
    numbers = rows.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("label"),
                          (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
                          *[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    sizes = {r[0]: r[1] for r in numbers.groupBy("fold").count().collect()}
    fitted = [sum(sizes.values()) - sizes.get(i, 0) for i in range(k)]
    if max(fitted) <= SMALL:
        make = lambda: M.scaled_pipeline(cols, M.make_estimator("gbt", params, label=label, weight=weight))
        return in_parallel(spark, [lambda i=i: make().fit(rows.filter(F.col(fold) != i)) for i in range(k)], slots)
    share = max(max(bins * bins, SAMPLE) / max(1, min(fitted)), 0.0)
    part = (numbers if share >= 1 else numbers.filter(F.rand(seed) < share)).toArrow()
    of, _, weights, *x = (c.to_numpy() for c in part.columns)
    with np.errstate(all="ignore"):
        pivot = np.array([v.mean() if len(v) else 0.0 for v in x])
        sums = _summed(numbers, _moments(pivot), k)
        models = []
        for i, n in enumerate(fitted):
            s, q = np.split(sum((a for j, a in sums.items() if j != i), np.zeros(2 * len(cols))), 2)
            mean = pivot + s / max(n, 1)
            deviation = np.sqrt(np.maximum(q - s * s / max(n, 1), 0) / max(n - 1, 1))
            scale = np.where(deviation != 0, 1 / deviation, 0.0)
            mine = of != i
            edges = [edges_of((v[mine] - m) * c, weights[mine], min(bins, n) - 1) for v, m, c in zip(x, mean, scale)]
            models.append(FoldTrees(cols, mean, scale, edges, depth))
    binned = cut(numbers.mapInArrow(_binned(models), "block binary"), "bins")
    for t in range(trees):
        # Splits so far, nodes to split, and those of them whose rows are counted: of two children the lighter, the other is the rest.
        growing = [({}, [1], [1]) for _ in models]
        values, above = [np.zeros(2 << depth) for _ in models], {}
        for level in range(depth):
            if not any(open_ for _, open_, _ in growing):
                break
            shared = spark.sparkContext.broadcast((models, growing))
            found = _summed(binned, _level(shared, level, bins), k)
            shared.destroy()
            following, sums = [], {}
            for i, (m, (splits, open_, counted)) in enumerate(zip(models, growing)):
                then, lighter = [], []
                if i in found and open_:
                    sums[i] = found[i].reshape(2, 1 << level, len(cols), bins).copy()
                    for node in counted if level else []:
                        sums[i][:, (node ^ 1) - (1 << level)] = above[i][:, (node >> 1) - (1 << level - 1)] - sums[i][:, node - (1 << level)]
                    for node in open_:
                        own = sums[i][:, node - (1 << level)]
                        best = _best(*own, [len(e) for e in m.thresholds], t == 0)
                        if best is None:
                            if node == 1 and any(len(e) for e in m.thresholds):
                                f = next(f for f, e in enumerate(m.thresholds) if len(e))
                                values[i][1] = own[1][f].sum() / own[0][f].sum() if own[0][f].sum() else 0.0
                            continue
                        gain, f, b, (low_w, low_s), (up_w, up_s) = best
                        m.gains[f] += gain
                        splits[node] = (f, b)
                        values[i][2 * node], values[i][2 * node + 1] = low_s / low_w, up_s / up_w
                        then += [2 * node, 2 * node + 1]
                        lighter.append(2 * node + int(up_w < low_w))
                following.append((splits, then, lighter))
            above = sums
            growing = following
        for m, (splits, _, _), v in zip(models, growing, values):
            m.trees.append((1.0 if t == 0 else step, splits, v))
    return models
