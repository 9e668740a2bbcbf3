"""Operators on the long score table ``(row_id, model_id, fold, proba, label)``:
blends, weight methods, threshold sweeps, subset search, AUC
(ag12, ag14-ag16, ag20, ev02, ev03, ev07, ev10-ev14, ev19, sc17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksmith.functions.metrics import confusion_aggs, f1_from_counts, predicted, with_metrics
from stacksmith.operators.rank import prefix_sum, unit_bucket

def mean_score(df: DataFrame, keys: Sequence[str], proba: str = "proba", out: str = "p") -> DataFrame:
    """ag15 / ev02: plain mean over the remaining rows (models, folds)."""
    return df.groupBy(*keys).agg(F.avg(proba).alias(out))


def weighted_mean(df: DataFrame, weights: DataFrame, keys: Sequence[str], on: Sequence[str],
                  proba: str = "proba", weight: str = "weight", out: str = "p") -> DataFrame:
    """ag14 / ev03: sum(w p) / sum(w) by ``keys``; ``weights`` is keyed by ``on``
    one row per model or per (model, fold); the planner broadcasts it if its size allows."""
    j = df.join(weights, list(on))
    return j.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(proba)) / F.sum(weight)).alias(out))


def f1_table(df: DataFrame, label: str, proba: str, group_cols: Sequence[str], threshold: float = 0.5,
             inclusive: bool = False) -> DataFrame:
    """ev14 / ag16 input: confusion counts and metrics per group."""
    return with_metrics(df.groupBy(*group_cols).agg(*confusion_aggs(label, predicted(proba, threshold, inclusive))))


def model_weights(f1: DataFrame, method: str = "naive", score: str = "f1", key: str = "model_id",
                  power: float = 4.0, temperature: float = 1.0, eps: float = 1e-8,
                  reverse: bool = False) -> DataFrame:
    """ev07: normalised weights from a (model, score) table (one row per model).

    naive: s / sum s;  power: s^p;  softmax: exp(s/T);  minmax: ((s-min)/(max-min)+eps)^p;
    rank: 1..n with the best model getting n (``reverse`` gives the best 1).
    All zero -> equal weights.
    """
    s = F.col(score).cast("double")
    allw = Window.partitionBy()
    if method == "naive":
        raw = s
    elif method == "power":
        raw = F.pow(s, F.lit(power))
    elif method == "softmax":
        raw = F.exp(s / F.lit(temperature))
    elif method == "minmax":
        lo, hi = F.min(s).over(allw), F.max(s).over(allw)
        norm = F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(F.lit(0.0))
        raw = F.pow(norm + F.lit(eps), F.lit(power))
    elif method == "rank":
        order = Window.partitionBy().orderBy(s.desc() if reverse else s.asc(), F.col(key))
        raw = F.row_number().over(order).cast("double")
    else:
        raise ValueError(f"unknown weight method {method!r}")
    t = f1.select(key, raw.alias("_raw"))
    tot = F.sum("_raw").over(allw)
    n = F.count(F.lit(1)).over(allw)
    w = F.when(tot > 0, F.col("_raw") / tot).otherwise(F.lit(1.0) / n)
    return t.select(key, w.alias("weight"))


def threshold_slot(p: Column, steps: int = 200) -> Column:
    """Largest j in 0..steps with p > j/steps; -1 if none."""
    j = F.ceil(p * steps).cast("int") - 1
    up = (j + 1).cast("double") / steps
    here = j.cast("double") / steps
    s = F.when(p > up, j + 1).when(p > here, j).otherwise(j - 1)
    return F.least(F.greatest(s, F.lit(-1)), F.lit(steps))


def threshold_sweep(df: DataFrame, label: str, proba: str, group_cols: Sequence[str] = (),
                    steps: int = 200) -> DataFrame:
    """ev10: F1 of ``p > j/steps`` for every j, in one pass over the scores.

    Rows are counted per (group, slot) -- partial aggregation leaves at most
    steps+2 rows per group and partition to shuffle -- then suffix sums over
    the slots (a table of (steps+1) rows per group) give TP and FP.
    """
    g = list(group_cols)
    y = F.col(label)
    counts = (df.select(*g, threshold_slot(F.col(proba), steps).alias("slot"), y.alias("_y"))
                .groupBy(*g, "slot")
                .agg(F.sum((F.col("_y") == 1).cast("long")).alias("_pos"),
                     F.sum((F.col("_y") == 0).cast("long")).alias("_neg")))
    totals = counts.groupBy(*g).agg(F.sum("_pos").alias("_P"))
    grid = totals.select(*g, "_P", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("slot"))
    full = grid.join(counts, [*g, "slot"], "left").na.fill(0, ["_pos", "_neg"])
    suffix = Window.partitionBy(*g).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    # rows in slot == steps also count (p > 1 never happens; kept for generality)
    tp = F.sum("_pos").over(suffix)
    fp = F.sum("_neg").over(suffix)
    out = full.select(*g, "slot", (F.col("slot").cast("double") / steps).alias("threshold"),
                      tp.alias("tp"), fp.alias("fp"), (F.col("_P") - tp).alias("fn"))
    return out.select(*g, "threshold", "tp", "fp", "fn", f1_from_counts().alias("f1"))


def best_threshold(sweep: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """First maximum (smallest threshold among ties)."""
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(F.desc("f1"), F.asc("threshold"))
    return (sweep.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
                 .select(*g, F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1")))


def subset_search(wide: DataFrame, label: str, models: Sequence[str], threshold: float = 0.5,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """ev11: F1 of the equal-weight mean of every non-empty subset of ``models``.

    The result has 2^n - 1 rows a group, so n is the caller's choice.  Each
    task counts hits of all masks over blocks of rows with numpy and hands on
    one row per (group, mask); no row of scores is expanded.
    """
    n, g = len(models), list(group_cols)
    y = F.col(label).cast("int").alias("_y")
    rows = wide.select(*g, y, F.array(*[F.col(m).cast("double") for m in models]).alias("_a"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.select(*g).schema), "mask int, pos long, neg long, hit_pos long, hit_neg long"])
    counts = rows.mapInPandas(_mask_counts(n, threshold, g), schema)
    agg = counts.groupBy(*g, "mask").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "hit_pos", "hit_neg")])
    names = F.array(*[F.lit(m) for m in models])
    members = F.array_join(F.filter(names, lambda x, i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0), "+")
    out = agg.select(*g, "mask", members.alias("members"), F.bit_count(F.col("mask")).cast("int").alias("n_members"),
                     F.col("hit_pos").alias("tp"), F.col("hit_neg").alias("fp"), (F.col("pos") - F.col("hit_pos")).alias("fn"))
    return out.withColumn("f1", f1_from_counts())


def _mask_counts(n: int, threshold: float, group_cols: list[str]):
    def run(frames):
        import numpy as np
        import pandas as pd

        sizes = np.array([m.bit_count() for m in range(1 << n)], float)
        sizes[0] = 1
        total: dict[tuple, np.ndarray] = {}
        step = max(1, (1 << 22) >> n)
        for frame in frames:
            parts = frame.groupby(group_cols, dropna=False) if group_cols else [((), frame)]
            for key, part in parts:
                a = np.array(part["_a"].tolist(), float).reshape(-1, n)
                positive = part["_y"].to_numpy() == 1
                negative = part["_y"].to_numpy() == 0
                sums = total.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((1 << n, 4), np.int64))
                for lo in range(0, len(a), step):
                    # Sums of all subsets, members added in order: each model doubles the table.
                    s = np.zeros((len(a[lo:lo + step]), 1))
                    for i in range(n):
                        s = np.concatenate([s, s + a[lo:lo + step, i:i + 1]], axis=1)
                    hit = s / sizes > threshold
                    p, q = positive[lo:lo + step], negative[lo:lo + step]
                    sums += np.column_stack([np.full(1 << n, p.sum()), np.full(1 << n, q.sum()), hit[p].sum(axis=0), hit[q].sum(axis=0)])
        for key, sums in total.items():
            out = pd.DataFrame(sums[1:], columns=["pos", "neg", "hit_pos", "hit_neg"])
            out.insert(0, "mask", np.arange(1, 1 << n, dtype=np.int32))
            for i, c in enumerate(group_cols):
                out.insert(i, c, key[i])
            yield out
    return run


def membership_weights(subsets: DataFrame, models: Sequence[str], top_k: int) -> DataFrame:
    """ag20 / ev12: count each model among the ``top_k`` best subsets
    (by F1, ties to the smaller mask) and normalise to weights.  The subset
    top rows come from per-partition tops, not from a window over all subsets."""
    top = subsets.orderBy(F.desc("f1"), F.asc("mask")).limit(top_k)
    exploded = top.select(F.explode(F.split("members", r"\+")).alias("model_id"))
    counts = exploded.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_in_top"))
    total = F.sum("n_in_top").over(Window.partitionBy())
    return counts.select("model_id", "n_in_top", (F.col("n_in_top") / total).alias("weight"))


def auc(df: DataFrame, label: str, proba: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """ag12: ROC-AUC with ties (a tie counts one half), per group.

    Scores collapse to (group, score, pos, neg).  Inside a bucket a window
    counts the negatives below each score; a bucket then is one row, and the
    negatives of the buckets before it are a running sum over at most 4 097
    rows a group, so no offset is joined back to the scores.
    """
    g = list(group_cols)
    per = (df.groupBy(*g, F.col(proba).alias("_v"))
             .agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
                  F.sum((F.col(label) == 0).cast("long")).alias("_neg")))
    lower = Window.partitionBy(*g, "_bkt").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = per.withColumn("_bkt", unit_bucket("_v")).withColumn("_below", F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    buckets = inside.groupBy(*g, "_bkt").agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") * 0.5)).alias("_num"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    before = F.coalesce(F.sum("_N").over(Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    agg = buckets.withColumn("_num", F.col("_num") + F.col("_P") * before).groupBy(*g).agg(
        F.sum("_num").alias("_num"), F.sum("_P").alias("_P"), F.sum("_N").alias("_N"))
    return agg.select(*g, (F.col("_num") / (F.col("_P") * F.col("_N"))).alias("auc"))


def min_max_per_group(df: DataFrame, col: str, group_cols: Sequence[str], out: str) -> DataFrame:
    """sc17: (x - min) / (max - min) inside each group; flat groups -> 0.
    Group extremes come from an aggregate joined back (one row per group)."""
    g = list(group_cols)
    ext = df.groupBy(*g).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.join(ext, g)
    v = F.when(F.col("_hi") > F.col("_lo"), (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return j.withColumn(out, v).drop("_lo", "_hi")
